"""Compliance, hunting and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.operators import metrics


def control_map(spark: SparkSession, framework: str) -> DataFrame:
    """(technique, control_id, control_name) of a framework: 'nist' or 'pci-dss'."""
    text = {"nist": fixed.NIST_BY_TECHNIQUE, "pci-dss": fixed.PCI_BY_TECHNIQUE}.get(framework)
    if text is None:
        raise ValueError(f"unknown framework {framework!r}")
    rows = [(t, c, fixed.CONTROL_NAMES.get(c, c)) for t, *cs in (line.split() for line in text.strip().splitlines()) for c in cs]
    return spark.createDataFrame(rows, "technique string, control_id string, control_name string")


def compliance_matrix(rules: DataFrame, framework: str) -> DataFrame:
    """Per control: its techniques, those covered by enabled rules, and whether any is."""
    active = metrics.rule_techniques(rules.where("enabled")).select("technique").distinct().withColumn("_a", F.lit(1))
    m = control_map(rules.sparkSession, framework).join(active, "technique", "left")
    got = F.when(F.col("_a").isNotNull(), F.col("technique"))
    return m.groupBy("control_id", "control_name").agg(
        F.array_sort(F.collect_set("technique")).alias("techniques"), F.array_sort(F.collect_set(got)).alias("covered_techniques")
    ).withColumn("covered", F.size("covered_techniques") > 0)


def compliance_summary(matrix: DataFrame) -> DataFrame:
    out = matrix.agg(F.count("*").alias("total_controls"), F.count_if("covered").alias("covered_controls"))
    return out.withColumn("coverage_pct", F.when(F.col("total_controls") > 0, F.round(F.col("covered_controls") / F.col("total_controls") * 100, 1)).otherwise(0.0))


def control_detection_counts(det: DataFrame) -> DataFrame:
    """Detections per control through the tactic map; tactics are counted before the map is joined."""
    rows = [(t, f, c) for t, nist, pci in fixed.CONTROLS_BY_TACTIC for f, cs in (("nist", nist), ("pci-dss", pci)) for c in cs.split()]
    m = det.sparkSession.createDataFrame(rows, "tactic string, framework string, control_id string")
    per = det.groupBy("tactic").agg(F.count("*").alias("n"))
    return m.join(per, "tactic").groupBy("framework", "control_id").agg(
        F.sum("n").alias("detections"), F.array_join(F.array_sort(F.collect_set("tactic")), ",").alias("tactics"))


def hunt_suggestions(det: DataFrame, rules: DataFrame, since_us: int, limit: int = 10, top: int | None = None, gap_limit: int | None = None) -> DataFrame:
    """Techniques worth hunting: recent activity beside rule coverage, plus pure gaps.

    Activity is already aggregated per technique, so every join here is catalogue-sized, and all of it is
    ranked. top and gap_limit cut the activity to its busiest rows and the gaps to the first ones before that.
    queries are searches to start from: the technique's events, and all of its tactic, since the given time.
    """
    act = metrics.technique_activity(det, since_us, top)
    # one suggestion per technique: its busiest row
    act = act.groupBy("technique_id").agg(F.max_by(F.struct("technique_name", "tactic", "count", "critical", "high"), F.struct("count", "tactic")).alias("a")).select("technique_id", "a.*")
    per_rule = metrics.rules_per_technique(rules).withColumnRenamed("rules", "rule_count")
    gaps = metrics.coverage_gaps(rules).withColumn("_gap", F.lit(True))
    live = act.join(per_rule, "technique_id", "left").join(gaps, "technique_id", "left").na.fill({"rule_count": 0, "_gap": False})
    pure = gaps.join(act.select("technique_id"), "technique_id", "left_anti").select(
        "technique_id", F.col("technique_id").alias("technique_name"), F.lit("Unknown").alias("tactic"), *[F.lit(0).cast("long").alias(c) for c in ("count", "critical", "high", "rule_count")], F.lit(True).alias("_gap"))
    if gap_limit is not None:
        pure = pure.orderBy("technique_id").limit(gap_limit)
    both = live.select(*pure.columns).unionByName(pure)
    n, c, h, r = (F.col(x) for x in ("count", "critical", "high", "rule_count"))
    priority = F.when((c > 0) | ((n > 0) & (r == 0)), "high").when((h > 0) | (n > 0), "medium").otherwise("low")
    plural = F.when(n != 1, "s").otherwise("")
    blind = F.when(n > 0, F.concat(n.cast("string"), F.lit(" detection"), plural, F.lit(" in window with no active rule coverage — manual hunting recommended"))).otherwise(
        "No active Sigma rule coverage — technique is a blind spot; manual hunting required")
    parts = F.concat_ws(
        "; ", F.when(n > 0, F.concat(n.cast("string"), F.lit(" detection"), plural, F.lit(" in analysis window"))), F.when(c > 0, F.concat(c.cast("string"), F.lit(" critical-severity"))),
        F.when(h > 0, F.concat(h.cast("string"), F.lit(" high-severity"))), F.when(r == 0, "no active rule coverage").when(r == 1, "1 active rule").otherwise(F.concat(r.cast("string"), F.lit(" active rules"))))
    out = both.withColumns({"priority": priority, "reason": F.when(F.col("_gap"), blind).otherwise(parts)})
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    hunt = F.array(*[F.struct(label.alias("label"), query.alias("query"), F.lit(since_us).alias("since_us")) for label, query in (
        (F.concat(F.lit("Hunt "), "technique_id", F.lit(": "), "technique_name"), F.col("technique_id")), (F.concat(F.lit("All "), "tactic", F.lit(" activity")), F.col("tactic")))])
    return out.withColumn("queries", hunt).orderBy(rank, F.desc("count"), "technique_id").limit(limit).drop("_gap")


def report_detections(det: DataFrame, start_us: int, end_us: int, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(a page of the period's newest rows; counts of the whole period by severity and tactic, and whether the page leaves rows out)."""
    period = det.where(F.col("time_us").between(start_us, end_us))
    rows = period.orderBy(F.desc("time_us"), F.asc("id")).limit(limit)
    total = F.sum(F.when(F.col("dim") == "severity", F.col("n"))).over(Window.partitionBy())
    g = F.explode(F.array(F.struct(F.lit("severity").alias("dim"), F.col("severity").alias("value")), F.struct(F.lit("tactic").alias("dim"), F.col("tactic").alias("value"))))
    counts = period.select(g.alias("g")).groupBy("g.dim", "g.value").agg(F.count("*").alias("n"))
    return rows, counts.select("dim", "value", "n", (total > limit).alias("truncated"))
