"""Counts and rates over detections, incidents, assets, indicators and rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import fixed

DAY_US = 86_400_000_000


def pct_change(now: Column, before: Column) -> Column:
    """Percent change; 100 when there was nothing before and something now."""
    return F.when(before > 0, F.round((now - before) / before * 100, 1)).when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def kpi_detections(det: DataFrame, start_us: int, end_us: int, today_us: int) -> DataFrame:
    """Four counters of this and the previous period of equal length from one scan."""
    t, span = F.col("time_us"), end_us - start_us
    cur = (t >= start_us) & (t <= end_us)
    return det.where(t.between(start_us - span, end_us)).agg(
        F.count_if(cur).alias("current"),
        F.count_if((t >= start_us - span) & (t < start_us)).alias("previous"),
        F.count_if(cur & (F.col("severity") == "critical")).alias("critical"),
        F.count_if((t >= today_us) & (t <= end_us) & (F.col("severity") == "critical")).alias("critical_today"),
    )


def tactic_trend(det: DataFrame, start_us: int, end_us: int) -> DataFrame:
    t, span = F.col("time_us"), end_us - start_us
    counted = det.where(t.between(start_us - span, end_us)).groupBy("tactic").agg(
        F.count_if(t >= start_us).alias("count"), F.count_if(t < start_us).alias("previous"))
    return counted.where(F.col("count") > 0).withColumn(
        "trend_pct", F.when(F.col("previous") > 0, F.round((F.col("count") - F.col("previous")) / F.col("previous") * 100, 1)).otherwise(F.lit(0.0)))


def technique_activity(det: DataFrame, since_us: int, top: int | None = None) -> DataFrame:
    out = (
        det.where((F.col("time_us") >= since_us) & F.col("technique_id").isNotNull())
        .groupBy("technique_id", "technique_name", "tactic", "tactic_id")
        .agg(F.count("*").alias("count"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    )
    if top is not None:
        out = out.orderBy(F.desc("count"), "technique_id", "tactic").limit(top)
    return out


def detection_timeline(det: DataFrame, start_us: int, days: int) -> DataFrame:
    """Per-day counts by severity with empty days filled in."""
    day = F.floor(F.col("time_us") / DAY_US).cast("long")
    first = start_us // DAY_US
    counts = det.where(day.between(first, first + days - 1)).groupBy(day.alias("day")).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")], F.count("*").alias("total"))
    calendar = det.sparkSession.range(first, first + days).withColumnRenamed("id", "day")
    return calendar.join(counts, "day", "left").na.fill(0)


def counts_by(df: DataFrame, dims: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Totals and one breakdown per dimension in one pass: (dim, value, measures)."""
    d = df.select(F.explode(F.array(
        F.struct(F.lit("total").alias("dim"), F.lit("").alias("value")),
        *[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in dims])).alias("g"), *[c.alias(n) for n, c in sums.items()])
    return d.groupBy("g.dim", "g.value").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in sums])


def incident_metrics(inc: DataFrame, week_us: int, month_us: int) -> DataFrame:
    closed = F.col("status").isin("resolved", "closed")
    return inc.agg(
        F.count("*").alias("total"),
        F.count_if(~closed).alias("open"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in ("new", "investigating", "contained", "resolved", "closed")],
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in ("critical", "high", "medium", "low")],
        F.round(F.avg(F.when(closed, F.col("ttr_seconds"))), 4).alias("avg_ttr"),
        F.round(F.avg("ttd_seconds"), 4).alias("avg_ttd"),
        F.count_if(F.col("created_us") >= week_us).alias("this_week"),
        F.count_if(F.col("created_us") >= month_us).alias("this_month"),
    )


# --------------------------------------------------------------------------------- rule coverage


def rule_techniques(rules: DataFrame) -> DataFrame:
    """(rule row, technique) for well-formed, non-blank technique lists."""
    ids = F.from_json(F.when(F.trim("technique_ids").startswith("["), F.col("technique_ids")), "array<string>")
    return rules.withColumn("technique", F.explode(F.transform(ids, lambda x: F.trim(x)))).where(F.length("technique") > 0)


def data_source(product: Column, service: Column, category: Column) -> Column:
    """Which sensor feeds a rule."""
    p, s, c = F.lower(F.coalesce(product, F.lit(""))), F.lower(F.coalesce(service, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    return (F.when(p.contains("zeek") | s.isin("dns", "http", "ssl", "conn"), "zeek")
            .when(p.contains("suricata") | c.isin("ids", "firewall"), "suricata").otherwise("wazuh"))


def coverage_rules(rules: DataFrame, total: int = fixed.COVERAGE_TOTAL) -> DataFrame:
    """covered counts up to the catalogue's total; techniques is the whole number, also what the catalogue does not have."""
    out = rule_techniques(rules.where("enabled")).agg(F.count_distinct("technique").alias("techniques")).withColumn("covered", F.least("techniques", F.lit(total).cast("long")))
    return out.select("covered", "techniques").withColumns({"total": F.lit(total).cast("long"), "pct": F.round(F.col("covered") / total * 100, 1)})


def coverage_by_datasource(rules: DataFrame, total: int = fixed.COVERAGE_TOTAL) -> DataFrame:
    """Distinct techniques and rules per sensor, plus the union over all sensors."""
    en = rules.where("enabled").withColumn("source", data_source(F.col("logsource_product"), F.col("logsource_service"), F.col("logsource_category")))
    both = F.explode(F.array(F.col("source"), F.lit("all")))
    n_rules = en.select(both.alias("source")).groupBy("source").agg(F.count("*").alias("rules"))
    tech = rule_techniques(en).select(F.col("technique"), both.alias("src")).groupBy("src").agg(F.count_distinct("technique").alias("techniques"))
    out = n_rules.join(tech, n_rules.source == tech.src, "left").select("source", "rules", F.coalesce("techniques", F.lit(0)).alias("techniques"))
    return out.withColumn("pct", F.round(F.least(F.col("techniques"), F.lit(total)) / total * 100, 1))


def coverage_gaps(rules: DataFrame) -> DataFrame:
    """Techniques named by some rule but by no enabled one."""
    t = rule_techniques(rules).groupBy("technique").agg(F.bool_or("enabled").alias("covered"))
    return t.where(~F.col("covered")).select(F.col("technique").alias("technique_id"))


def rules_per_technique(rules: DataFrame) -> DataFrame:
    return rule_techniques(rules.where("enabled")).groupBy(F.col("technique").alias("technique_id")).agg(F.count("*").alias("rules"))


def heatmap(det: DataFrame) -> DataFrame:
    """Technique family x tactic grid of distinct detected ids: seen, and covered, which stops at the column's total."""
    spark = det.sparkSession
    cols = [(t, label, int(total), i) for i, (t, label, total) in enumerate(fixed.HEATMAP_COLUMNS)]
    grid = spark.createDataFrame(
        [(f, r, *c) for r, f in enumerate(fixed.HEATMAP_FAMILIES) for c in cols],
        "family string, row int, tactic string, label string, total int, col int")
    fams = F.filter(F.array(*map(F.lit, fixed.HEATMAP_FAMILIES)), lambda f: F.startswith(F.col("technique_id"), f))
    seen = (det.where(F.col("technique_id").isNotNull() & F.col("tactic").isNotNull()).groupBy("technique_id", "tactic").agg(F.lit(1).alias("x"))
            .select("tactic", "technique_id", F.explode(fams).alias("family")).groupBy("family", "tactic").agg(F.count_distinct("technique_id").alias("seen")))
    return grid.join(seen, ["family", "tactic"], "left").select(
        "family", "row", "label", "col", F.least(F.coalesce("seen", F.lit(0)), F.col("total")).cast("long").alias("covered"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"), "total")
