"""Dashboards: detection KPIs, trends, incidents, assets, indicators, rules and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.operators import metrics as m
from wardlake.plans.registry import query
from wardlake.plans.views import DAY_US, NOW_US

WEEK, MONTH = NOW_US - 7 * DAY_US, NOW_US - 30 * DAY_US


@query("kpi_detections", f"""SELECT count(*) FILTER (WHERE time_us >= {WEEK} AND time_us <= {NOW_US}) AS current,
 count(*) FILTER (WHERE time_us >= {WEEK - 7 * DAY_US} AND time_us < {WEEK}) AS previous,
 count(*) FILTER (WHERE time_us >= {WEEK} AND severity = 'critical') AS critical,
 count(*) FILTER (WHERE time_us >= {NOW_US - 2 * DAY_US} AND severity = 'critical') AS critical_today FROM v_detections WHERE time_us <= {NOW_US}""")
def kpi_detections(lake):
    return m.kpi_detections(lake.detections, WEEK, NOW_US, NOW_US - 2 * DAY_US)


@query("kpi_overview", f"""WITH d AS (SELECT count(*) FILTER (WHERE time_us >= {WEEK}) AS cur, count(*) FILTER (WHERE time_us < {WEEK}) AS prev FROM v_detections WHERE time_us BETWEEN {WEEK - 7 * DAY_US} AND {NOW_US}),
 i AS (SELECT round(avg(ttd_seconds) / 60, 2) AS mttd, round(avg(CASE WHEN status IN ('resolved','closed') THEN ttr_seconds END) / 60, 2) AS mttr FROM v_incidents),
 c AS (SELECT count(DISTINCT technique_id) AS covered FROM v_detections)
 SELECT cur AS detections, CASE WHEN prev > 0 THEN round((cur - prev) / prev * 100, 1) WHEN cur > 0 THEN 100.0 ELSE 0.0 END AS delta_pct, mttd AS mttd_minutes, mttr AS mttr_minutes, covered, round(covered / 420 * 100, 1) AS coverage_pct FROM d, i, c""")
def kpi_overview(lake):
    """Headline cards: three one-row aggregates, combined as scalar subqueries."""
    closed = F.col("status").isin("resolved", "closed")
    d = m.kpi_detections(lake.detections, WEEK, NOW_US, NOW_US - 2 * DAY_US)
    mttd = lake.incidents.agg(F.round(F.avg("ttd_seconds") / 60, 2)).scalar()
    mttr = lake.incidents.agg(F.round(F.avg(F.when(closed, F.col("ttr_seconds"))) / 60, 2)).scalar()
    covered = lake.detections.agg(F.count_distinct("technique_id")).scalar()
    out = d.select(F.col("current").alias("detections"), m.pct_change(F.col("current"), F.col("previous")).alias("delta_pct"),
                   mttd.alias("mttd_minutes"), mttr.alias("mttr_minutes"), covered.alias("covered"))
    return out.withColumn("coverage_pct", F.round(F.col("covered") / 420 * 100, 1))


@query("tactic_trend", f"""SELECT *, CASE WHEN previous > 0 THEN round((count - previous) / previous * 100, 1) ELSE 0.0 END AS trend_pct FROM (
 SELECT tactic, count(*) FILTER (WHERE time_us >= {WEEK}) AS count, count(*) FILTER (WHERE time_us < {WEEK}) AS previous FROM v_detections WHERE time_us BETWEEN {WEEK - 7 * DAY_US} AND {NOW_US} GROUP BY 1) t WHERE count > 0""")
def tactic_trend(lake):
    return m.tactic_trend(lake.detections, WEEK, NOW_US).orderBy(F.desc("count"), "tactic")


@query("coverage_detected", "SELECT count(DISTINCT technique_id) AS detected, round(count(DISTINCT technique_id) / 105 * 100, 1) AS pct FROM v_detections")
def coverage_detected(lake):
    out = lake.detections.agg(F.count_distinct("technique_id").alias("detected"))
    return out.withColumn("pct", F.round(F.col("detected") / fixed.COVERAGE_TOTAL * 100, 1))


_FAMS = ", ".join(f"('{f}', {i})" for i, f in enumerate(fixed.HEATMAP_FAMILIES))
_COLS = ", ".join(f"('{t}', '{lab}', {tot}, {i})" for i, (t, lab, tot) in enumerate(fixed.HEATMAP_COLUMNS))
_HEAT = f"""SELECT f.family, f.row, c.label, c.col, least(count(DISTINCT d.technique_id), c.total) AS covered, count(DISTINCT d.technique_id) AS seen, c.total
 FROM (VALUES {_FAMS}) f(family, row) CROSS JOIN (VALUES {_COLS}) c(tactic, label, total, col) LEFT JOIN (SELECT DISTINCT technique_id, tactic FROM v_detections) d ON d.tactic = c.tactic AND starts_with(d.technique_id, f.family)
 GROUP BY f.family, f.row, c.label, c.col, c.total"""


@query("heatmap", _HEAT)
def heatmap(lake):
    return m.heatmap(lake.detections)


@query("coverage_by_tactic", f"SELECT label, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(total) AS BIGINT) AS total, round(sum(covered) / sum(total) * 100, 1) AS pct FROM ({_HEAT}) h WHERE col < 7 GROUP BY label")
def coverage_by_tactic(lake):
    """Heatmap summed over families for the first seven columns."""
    h = m.heatmap(lake.detections).where(F.col("col") < 7)
    return h.groupBy("label").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total")).withColumn("pct", F.round(F.col("covered") / F.col("total") * 100, 1))


@query("technique_activity", f"""SELECT technique_id, technique_name, tactic, tactic_id, count(*) AS count, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high
 FROM v_detections WHERE technique_id IS NOT NULL AND time_us >= {WEEK} GROUP BY 1, 2, 3, 4 ORDER BY 5 DESC, 1, 3 LIMIT 20""")
def technique_activity(lake):
    return m.technique_activity(lake.detections, WEEK, 20)


@query("detection_timeline", f"""SELECT g.day, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
 count(*) FILTER (WHERE severity = 'low') AS low, count(severity) AS total FROM (SELECT unnest(generate_series({NOW_US // DAY_US - 14}, {NOW_US // DAY_US + 3})) AS day) g LEFT JOIN v_detections d ON d.time_us // {DAY_US} = g.day GROUP BY 1""")
def detection_timeline(lake):
    return m.detection_timeline(lake.detections, NOW_US - 14 * DAY_US, 18)


_ST = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS status_{s}" for s in ("new", "investigating", "contained", "resolved", "closed"))
_SV = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS severity_{s}" for s in ("critical", "high", "medium", "low"))
_INC = f"""SELECT count(*) AS total, count(*) FILTER (WHERE status NOT IN ('resolved','closed')) AS open, {_ST}, {_SV}, round(avg(CASE WHEN status IN ('resolved','closed') THEN ttr_seconds END), 4) AS avg_ttr,
 round(avg(ttd_seconds), 4) AS avg_ttd, count(*) FILTER (WHERE created_us >= {WEEK}) AS this_week, count(*) FILTER (WHERE created_us >= {MONTH}) AS this_month FROM v_incidents"""


@query("incident_metrics", _INC)
def incident_metrics(lake):
    return m.incident_metrics(lake.incidents, WEEK, MONTH)


def _by(view, dims, extra=""):
    parts = [f"SELECT 'total' AS dim, '' AS value, count(*) AS n{extra} FROM {view}"]
    parts += [f"SELECT '{c}', CAST({c} AS STRING), count(*){extra} FROM {view} GROUP BY {c}" for c in dims]
    return " UNION ALL ".join(parts)


@query("asset_stats", _by("v_assets", ["asset_type", "criticality", "os_family"]))
def asset_stats(lake):
    return m.counts_by(lake.assets, ["asset_type", "criticality", "os_family"], {})


@query("ioc_stats", _by("v_iocs", ["ioc_type", "feed"], f", CAST(sum(hit_count) AS BIGINT) AS hits, CAST(sum(CASE WHEN is_active THEN 1 ELSE 0 END) AS BIGINT) AS active, CAST(sum(CASE WHEN expires_us <= {NOW_US} THEN 1 ELSE 0 END) AS BIGINT) AS expired"))
def ioc_stats(lake):
    return m.counts_by(lake.iocs, ["ioc_type", "feed"], {
        "hits": F.col("hit_count"), "active": F.col("is_active").cast("long"), "expired": F.when(F.col("expires_us") <= NOW_US, 1).otherwise(0).cast("long")})


@query("rules_summary", _by("v_rules", ["level"], ", CAST(sum(CASE WHEN enabled THEN 1 ELSE 0 END) AS BIGINT) AS enabled"))
def rules_summary(lake):
    return m.counts_by(lake.rules, ["level"], {"enabled": F.col("enabled").cast("long")})


@query("rule_kpis", f"SELECT count(*) FILTER (WHERE enabled) AS active, count(*) FILTER (WHERE enabled AND level = 'critical') AS critical, count(*) FILTER (WHERE enabled AND level = 'high') AS high, count(*) FILTER (WHERE created_us >= {WEEK}) AS this_week FROM v_rules")
def rule_kpis(lake):
    en = F.col("enabled")
    return lake.rules.agg(F.count_if(en).alias("active"), F.count_if(en & (F.col("level") == "critical")).alias("critical"),
                          F.count_if(en & (F.col("level") == "high")).alias("high"), F.count_if(F.col("created_us") >= WEEK).alias("this_week"))


@query("connector_counts", "SELECT count(*) FILTER (WHERE enabled) AS active, count(*) AS total FROM v_channels")
def connector_counts(lake):
    return lake.channels.agg(F.count_if("enabled").alias("active"), F.count("*").alias("total"))


_TECH = """(SELECT id, enabled, logsource_product, logsource_service, logsource_category, trim(unnest(CAST(json(technique_ids) AS VARCHAR[]))) AS technique FROM v_rules WHERE technique_ids LIKE '[%') t0 WHERE technique <> ''"""
_SRC = """CASE WHEN logsource_product LIKE '%zeek%' OR logsource_service IN ('dns','http','ssl','conn') THEN 'zeek' WHEN logsource_product LIKE '%suricata%' OR logsource_category IN ('ids','firewall') THEN 'suricata' ELSE 'wazuh' END"""


@query("coverage_rules", f"SELECT least(count(DISTINCT technique), 105) AS covered, count(DISTINCT technique) AS techniques, CAST(105 AS BIGINT) AS total, round(least(count(DISTINCT technique), 105) / 105 * 100, 1) AS pct FROM {_TECH} AND enabled")
def coverage_rules(lake):
    return m.coverage_rules(lake.rules)


@query("coverage_by_datasource", f"""WITH t AS (SELECT *, {_SRC} AS source FROM {_TECH} AND enabled), r AS (SELECT {_SRC} AS source FROM v_rules WHERE enabled),
 rr AS (SELECT source, count(*) AS rules FROM r GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM r), tt AS (SELECT source, count(DISTINCT technique) AS techniques FROM t GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT technique) FROM t)
 SELECT rr.source, rules, coalesce(techniques, 0) AS techniques, round(least(coalesce(techniques, 0), 105) / 105 * 100, 1) AS pct FROM rr LEFT JOIN tt ON rr.source = tt.source""")
def coverage_by_datasource(lake):
    return m.coverage_by_datasource(lake.rules)


_LIVE = "enabled AND id % 10 NOT IN (5, 7) AND hit_count % 10 NOT IN (5, 7)"


@query("coverage_gaps", f"SELECT technique AS technique_id FROM (SELECT technique, bool_or(live) AS c FROM (SELECT {_LIVE} AS live, trim(unnest(CAST(json(technique_ids) AS VARCHAR[]))) AS technique FROM v_rules WHERE technique_ids LIKE '[%') t0 WHERE technique <> '' GROUP BY 1) t WHERE NOT c")
def coverage_gaps(lake):
    return m.coverage_gaps(lake.rules.withColumn("enabled", F.expr(_LIVE))).orderBy("technique_id")


@query("coverage_target", "SELECT CAST(80.0 AS DOUBLE) AS target_pct, pct AS current_pct, pct < 80.0 AS below_threshold FROM (SELECT round(least(count(DISTINCT technique), 105) / 105 * 100, 1) AS pct FROM " + _TECH + " AND enabled) t")
def coverage_target(lake):
    """Current coverage beside an enabled target of 80 %."""
    return m.coverage_rules(lake.rules).select(F.lit(80.0).alias("target_pct"), F.col("pct").alias("current_pct"), (F.col("pct") < 80.0).alias("below_threshold"))


@query("rules_per_technique", f"SELECT technique AS technique_id, count(*) AS rules FROM {_TECH} AND enabled GROUP BY 1")
def rules_per_technique(lake):
    return m.rules_per_technique(lake.rules)


@query("navigator_layer", f"""WITH s AS (SELECT technique AS technique_id, count(*) AS score FROM {_TECH} AND enabled GROUP BY 1)
 SELECT concat('{{"name":"coverage","max":', CAST(max(score) AS STRING), ',"techniques":[', string_agg(concat('{{"techniqueID":"', technique_id, '","score":', CAST(score AS STRING), '}}'), ',' ORDER BY technique_id), ']}}') AS layer FROM s""")
def navigator_layer(lake):
    """One JSON document: technique -> number of enabled rules (bounded by the technique catalogue)."""
    s = m.rules_per_technique(lake.rules)
    return s.agg(F.to_json(F.struct(
        F.lit("coverage").alias("name"), F.max("rules").alias("max"),
        F.array_sort(F.collect_list(F.struct(F.col("technique_id").alias("techniqueID"), F.col("rules").alias("score")))).alias("techniques"))).alias("layer"))


@query("coverage_trend", f"SELECT day, n AS techniques, round(n / 105 * 100, 1) AS pct FROM (SELECT time_us // {DAY_US} AS day, count(DISTINCT technique_id) AS n FROM v_detections GROUP BY 1) t ORDER BY day DESC LIMIT 14")
def coverage_trend(lake):
    """Daily snapshots, one per date (the later write wins), newest 14 in ascending order."""
    from wardlake.operators.tables import upsert

    day = F.floor(F.col("time_us") / DAY_US).cast("long").alias("day")
    fresh = lake.detections.groupBy(day).agg(F.count_distinct("technique_id").alias("techniques"))
    stale = fresh.withColumn("techniques", F.lit(0).cast("long")).where(F.col("day") % 2 == 0)
    merged = upsert(stale, fresh, ["day"])
    return merged.withColumn("pct", F.round(F.col("techniques") / fixed.COVERAGE_TOTAL * 100, 1)).orderBy(F.desc("day")).limit(14).orderBy("day")


@query("catalogue_report", """SELECT tactic, count(DISTINCT technique_id) AS techniques, count(DISTINCT CASE WHEN technique_id NOT LIKE '%.%' THEN technique_id END) AS parents, round(count(DISTINCT technique_id) / 201 * 100, 2) AS pct FROM v_detections GROUP BY 1
 UNION ALL SELECT 'all', count(DISTINCT technique_id), count(DISTINCT CASE WHEN technique_id NOT LIKE '%.%' THEN technique_id END), round(count(DISTINCT technique_id) / 201 * 100, 2) FROM v_detections""")
def catalogue_report(lake):
    """Distinct techniques and parents per tactic and overall, as a share of the catalogue."""
    d = lake.detections.groupBy("tactic", "technique_id").agg(F.lit(1).alias("x"))
    g = d.select(F.explode(F.array("tactic", F.lit("all"))).alias("tactic"), "technique_id")
    parent = F.when(~F.col("technique_id").contains("."), F.col("technique_id"))
    return g.groupBy("tactic").agg(F.count_distinct("technique_id").alias("techniques"), F.count_distinct(parent).alias("parents")).withColumn("pct", F.round(F.col("techniques") / fixed.CATALOGUE_TOTAL * 100, 2))


@query("retention_stats", f"""SELECT 'detections' AS tbl, count(*) AS total, count(*) FILTER (WHERE time_us < {NOW_US} - 10 * {DAY_US}) AS eligible FROM v_detections UNION ALL
 SELECT 'incidents', count(*), count(*) FILTER (WHERE status IN ('resolved','closed') AND closed_us < {NOW_US} - 10 * {DAY_US}) FROM v_incidents UNION ALL SELECT 'iocs', count(*), count(*) FILTER (WHERE expires_us < {NOW_US} - 10 * {DAY_US}) FROM v_iocs""")
def retention_stats(lake):
    from wardlake.operators.tables import retention_predicates

    old = retention_predicates(NOW_US, detections_days=10, incidents_days=10, iocs_days=10)
    parts = [getattr(lake, t).agg(F.lit(t).alias("tbl"), F.count("*").alias("total"), F.count_if(p).alias("eligible")) for t, p in old.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("rate_report", f"SELECT * FROM (SELECT source, time_us // 3600000000 AS hour, count(*) AS n FROM v_events GROUP BY 1, 2) t WHERE n > 5")
def rate_report(lake):
    """Keys over their rate limit per fixed window (here 5 per hour)."""
    return lake.events.groupBy("source", F.floor(F.col("time_us") / 3_600_000_000).cast("long").alias("hour")).agg(F.count("*").alias("n")).where("n > 5")


@query("alert_metrics", "SELECT 'severity' AS metric, severity AS label, count(*) AS n FROM v_detections GROUP BY 2 UNION ALL SELECT 'rule', coalesce(rule_name, 'none'), count(*) FROM v_detections GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM v_events GROUP BY 2")
def alert_metrics(lake):
    """Counters of alerts by severity and rule and of events by source."""
    d = lake.detections.groupBy("severity", F.coalesce("rule_name", F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))
    both = d.select(F.explode(F.array(F.struct(F.lit("severity").alias("metric"), F.col("severity").alias("label")), F.struct(F.lit("rule").alias("metric"), F.col("rule").alias("label")))).alias("g"), "n")
    ev = lake.events.groupBy(F.lit("source").alias("metric"), F.col("source").alias("label")).agg(F.count("*").alias("n"))
    return both.groupBy("g.metric", "g.label").agg(F.sum("n").alias("n")).unionByName(ev)


@query("dlq_counts", "SELECT source, CASE WHEN hostname IS NULL THEN 'schema_validation' ELSE 'normalization_error' END AS error_type, count(*) AS n FROM v_events WHERE hostname IS NULL OR username IS NULL GROUP BY 1, 2")
def dlq_counts(lake):
    from wardlake.operators.normalize import split_dead_letters

    checks = [("schema_validation", F.col("hostname").isNull(), "hostname missing"), ("normalization_error", F.col("username").isNull(), "username missing")]
    _, dead = split_dead_letters(lake.events, checks, F.col("source"))
    return dead.groupBy("source", "error_type").agg(F.count("*").alias("n"))
