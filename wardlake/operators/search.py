"""Event search: predicates, pages, terms, histograms."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.net import all_of, any_of

# names callers may filter on -> column of the flat event table
FIELDS = {n: n for n in ("class_uid", "class_name", "severity_id", "src_ip", "dst_ip", "hostname", "username",
                         "process_hash", "source")}
FIELDS |= {"src_endpoint.ip": "src_ip", "dst_endpoint.ip": "dst_ip", "actor_user.name": "username",
           "src_endpoint.hostname": "hostname", "process.hash_sha256": "process_hash"}
_OPS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "contains": lambda c, v: contains_ci(c, v),
}
_UNIT_S = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000, "y": 31536000}


def contains_ci(col: Column, text) -> Column:
    """Case-insensitive substring; the text is literal, never a pattern."""
    return F.contains(F.lower(col.cast("string")), F.lit(str(text).lower()))


def event_filter(filters: Sequence[tuple[str, str, object]]) -> Column:
    """AND of (field, op, value); names outside the allow-list are ignored."""
    preds = []
    for field, op, value in filters:
        if field in FIELDS and op in _OPS:
            preds.append(_OPS[op](F.col(FIELDS[field]), value))
    return all_of(preds)


def resolve_time(text: str, now_us: int) -> int:
    """'now', 'now-7d' or an ISO instant -> microseconds."""
    if text == "now":
        return now_us
    m = re.fullmatch(r"now-(\d+)([smhdwMy])", text)
    if m:
        return now_us - int(m.group(1)) * _UNIT_S[m.group(2)] * 1_000_000
    at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return int(at.timestamp() * 1_000_000)


def time_range(start: str, end: str, now_us: int, col: str = "time_us", date_col: str | None = None) -> Column:
    """Inclusive range; ``date_col`` adds the matching filter on a date partition column."""
    lo, hi = resolve_time(start, now_us), resolve_time(end, now_us)
    pred = F.col(col).between(lo, hi)
    if date_col:
        day = [dt.datetime.fromtimestamp(x / 1e6, dt.timezone.utc).date() for x in (lo, hi)]
        pred = F.col(date_col).between(F.lit(day[0]), F.lit(day[1])) & pred
    return pred


def text_search(q: str, columns: Sequence[str] = ("summary", "hostname", "username", "src_ip", "dst_ip")) -> Column:
    return any_of([F.coalesce(contains_ci(F.col(c), q), F.lit(False)) for c in columns])


def token_search(q: str, columns: Sequence[str] = ("summary", "class_name", "hostname", "username")) -> Column:
    """Every token of the query occurs as a token of some column."""
    tokens = re.findall(r"[a-z0-9]+", q.lower())
    words = F.split(F.lower(F.concat_ws(" ", *columns)), "[^a-z0-9]+")
    return all_of([F.array_contains(words, t) for t in tokens])


def rule_query(text: str, columns: Sequence[str]) -> Column:
    """'field op value' filters before the first '|'; no usable filter matches nothing."""
    preds = []
    for field, op, raw in re.findall(r'(\w+)\s*(>=|<=|>|<|=)\s*("[^"]*"|\S+)', text.split("|")[0].strip()):
        if field not in columns:
            return F.lit(False)
        value, c = raw.strip('"'), F.col(field)
        if op == "=" and "*" in value and field != "source":
            pattern = "".join(".*" if ch == "*" else re.escape(ch) for ch in value)
            preds.append(c.cast("string").rlike(f"^{pattern}$"))
        elif op == "=":
            preds.append(c.cast("string") == value)
        else:
            try:
                number = float(value)
            except ValueError:
                number = 0.0
            preds.append({">": c > number, ">=": c >= number, "<": c < number, "<=": c <= number}[op])
    return F.coalesce(all_of(preds), F.lit(False)) if preds else F.lit(False)


def is_broad_query(text: str) -> bool:
    return re.fullmatch(r"source=\w+", text.strip()) is not None


def entity_filter(kind: str, value: str) -> Column:
    fields = {"ip": ("src_ip", "dst_ip"), "host": ("hostname",), "user": ("username",), "hash": ("process_hash",)}[kind]
    return any_of([F.col(f) == value for f in fields])


def page(df: DataFrame, order: Sequence[Column], limit: int | None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def search_events(ev: DataFrame, where: Column, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(ev.where(where), [F.desc("time_us"), F.asc("id")], limit, offset)


def terms(df: DataFrame, field: str, top: int = 10) -> DataFrame:
    """Most frequent values; NULL is no value. Ties by value."""
    return (
        df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("key")).agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("key")).limit(top)
    )


def date_histogram(df: DataFrame, unit: str, time: str = "time") -> DataFrame:
    """Counts per minute/hour/day/week/month; empty buckets are absent."""
    return df.groupBy(F.date_trunc(unit, F.col(time)).alias("bucket")).agg(F.count("*").alias("count"))
