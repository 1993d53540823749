"""Scoring of queried names: generated domains and tunnelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions.net import any_of
from wardlake.functions.text import once, shannon_entropy


def second_level(name: Column) -> Column:
    """Label before the last one; the only label when there is one."""
    labels = F.split(F.rtrim(name, F.lit(".")), r"\.")
    return F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2)).otherwise(F.get(labels, F.lit(0)))


def base_domain(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def dga_features(sld: Column) -> dict[str, Column]:
    """Counts over a lower-cased second-level label that the score is built from."""
    s = F.lower(sld)
    pairs = F.filter(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2))), lambda p: p.rlike("^[a-z]{2}$"))
    return {
        "_s": s, "_n": F.octet_length(s), "_digits": F.regexp_count(s, F.lit("[0-9]")), "_letters": F.regexp_count(s, F.lit("[a-z]")),
        "_vowels": F.regexp_count(s, F.lit("[aeiou]")),
        "_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit("([bcdfghjklmnpqrstvwxyz]+)"), F.lit(1)), F.length)), F.lit(0)),
        "_pairs": pairs,
    }


def dga_score() -> Column:
    """Sum of six signals over the columns of ``dga_features``, at most 1."""
    s, n, letters, run = F.col("_s"), F.col("_n"), F.col("_letters"), F.col("_run")
    digits, vowels = F.col("_digits") / n, F.col("_vowels") / letters
    common = F.size(F.filter("_pairs", lambda p: p.isin(*fixed.COMMON_BIGRAMS))) / F.size("_pairs")
    length_s = F.when(n <= 9, 0.0).when(n <= 15, 0.05).when(n <= 20, 0.15).when(n <= 30, 0.25).otherwise(0.35)
    digit_s = F.when(digits > 0.5, 0.25).when(digits > 0.3, 0.15).when(digits > 0.1, 0.05).otherwise(0.0)
    vowel_s = F.when(letters == 0, 0.25).when(vowels < 0.1, 0.25).when(vowels < 0.2, 0.15).when(vowels < 0.3, 0.05).otherwise(0.0)
    run_s = F.when(run > 6, 0.20).when(run > 4, 0.10).otherwise(0.0)
    shape_s = F.when((n > 8) & s.rlike("^[0-9a-f]+$"), 0.40).when((n > 10) & s.rlike("^[a-z2-7]+$") & s.rlike("[2-7]"), 0.30).otherwise(0.0)
    pair_s = F.when(F.length(s) < 4, 0.0).when(F.size("_pairs") == 0, 0.20).when(common < 0.1, 0.20).when(common < 0.2, 0.10).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), length_s + digit_s + vowel_s + run_s + shape_s + pair_s))


def dga(df: DataFrame, name: str, min_len: int = 6, high: float = 0.7, medium: float = 0.5) -> DataFrame:
    """Queries whose name looks generated. Whitelisted platforms and short labels are skipped first."""
    out = once(df, _low=F.lower(name), sld=second_level(F.col(name)))
    out = out.where((F.octet_length("sld") >= min_len) & ~any_of([F.col("_low").contains(w) for w in fixed.DGA_WHITELIST]))
    out = once(once(out, **dga_features(F.col("sld"))), score=F.round(dga_score(), 2))
    out = out.where(F.col("score") >= medium).withColumn("severity", F.when(F.col("score") >= high, "high").otherwise("medium"))
    return out.drop("_low", "_s", "_n", "_digits", "_letters", "_vowels", "_run", "_pairs")


def dns_tunnel(df: DataFrame, name: str, qtype: str, ts: str, order_id: str, entropy: float = 4.5, max_len: int = 100, burst: int = 100) -> DataFrame:
    """First matching reason per query, in fixed order; the volume reason counts per base domain.

    Only names no earlier reason caught are counted, and every (burst + 1)th of them fires. The
    running count is kept per (domain, hour) plus carried totals, so a popular domain is not one task.
    """
    from wardlake.operators.timeline import SECOND, running_sum

    labels = F.split(F.col(name), r"\.")
    payload = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), "")
    first = F.get(labels, F.lit(0))
    early = (
        F.when(F.octet_length(name) > max_len, "name_length")
        .when(F.exists(labels, lambda x: F.octet_length(x) > 40), "label_length")
        .when((F.octet_length(first) > 10) & (shannon_entropy(first) > entropy), "label_entropy")
        .when((F.size(labels) > 3) & (F.octet_length(payload) > 20) & (shannon_entropy(payload) > entropy), "combined_entropy")
        .when(F.size(labels) > 10, "depth")
    )
    marked = once(df, _early=early, _base=base_domain(F.col(name)))
    counted = running_sum(marked, ["_base"], [order_id], ts, {"_n": F.col("_early").isNull().cast("long")}, 3600 * SECOND)
    volume = F.col("_early").isNull() & (F.pmod("_n", F.lit(burst + 1)) == 0)
    late = F.when(volume, "volume").when(F.col(qtype) == "TXT", "txt_query").when(F.col(qtype) == "NULL", "null_query").when(F.col(qtype) == "ANY", "any_query")
    out = counted.withColumn("reason", F.coalesce("_early", late)).where("reason IS NOT NULL")
    sev = F.when(F.col("reason").isin("name_length", "label_length", "label_entropy"), "high").when(F.col("reason").isin("txt_query", "any_query"), "low").otherwise("medium")
    return out.withColumn("severity", sev).drop("_early", "_base", "_n")
