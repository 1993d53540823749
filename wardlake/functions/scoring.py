"""Risk scores, severity ranks and truncations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake import fixed


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Small fixed mapping as a column."""
    out = F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)
    return out if default is None else F.coalesce(out, F.lit(default))


def level_rank(level: Column) -> Column:
    return lookup(F.lower(level), fixed.LEVEL_RANK, 0)


def at_least(level: Column, floor: str) -> Column:
    return level_rank(level) >= fixed.LEVEL_RANK[floor]


def risk_score(severity_id: Column, criticality: Column, recurrence: Column, boost: Column) -> Column:
    """0-10: weighted severity, asset criticality (0-1) and recurrence, plus the intelligence boost."""
    base = ((severity_id - 1) / 4 * 0.60 + criticality * 0.25 + F.least(recurrence / 10.0, F.lit(1.0)) * 0.15) * 10.0
    return F.bround(F.least(base + boost, F.lit(10.0)), 1)


def merged_score(severity: Column, n: Column) -> Column:
    """Score of a merged detection: base by severity plus up to one for volume."""
    base = lookup(F.lower(severity), {"critical": 9.0, "high": 7.0, "medium": 5.0, "low": 3.0, "informational": 1.0}, 5.0)
    return F.least(base + F.least(F.lit(1.0), F.log10(F.greatest(n, F.lit(1))) / 4), F.lit(10.0))
