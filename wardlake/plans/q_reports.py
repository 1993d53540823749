"""Compliance, hunting, reports, incidents, roll-ups and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.operators import incidents as inc
from wardlake.operators import metrics as m
from wardlake.operators import reports as rp
from wardlake.operators import rollups as ro
from wardlake.operators import rules as rl
from wardlake.plans.q_metrics import _TECH
from wardlake.plans.q_rules import DETECT_SQL, RULES
from wardlake.plans.registry import query
from wardlake.plans.views import DAY_US, NOW_US

HOUR_US = 3_600_000_000


def _controls(text):
    return ", ".join(f"('{t}', '{c}')" for t, *cs in (ln.split() for ln in text.strip().splitlines()) for c in cs)


def _matrix(text):
    return f"""(SELECT control_id, string_agg(technique, ',' ORDER BY technique) AS techniques, coalesce(string_agg(CASE WHEN a.t IS NOT NULL THEN technique END, ',' ORDER BY technique), '') AS covered_techniques, count(a.t) > 0 AS covered
 FROM (VALUES {_controls(text)}) m(technique, control_id) LEFT JOIN (SELECT DISTINCT technique AS t FROM {_TECH} AND enabled) a ON a.t = m.technique GROUP BY 1)"""


@query("compliance_matrix", " UNION ALL ".join(f"SELECT '{n}' AS framework, * FROM {_matrix(t)} x" for n, t in (("nist", fixed.NIST_BY_TECHNIQUE), ("pci-dss", fixed.PCI_BY_TECHNIQUE))))
def compliance_matrix(lake):
    parts = [rp.compliance_matrix(lake.rules, f).select(F.lit(f).alias("framework"), "control_id", F.array_join("techniques", ",").alias("techniques"), F.array_join("covered_techniques", ",").alias("covered_techniques"), "covered") for f in ("nist", "pci-dss")]
    return parts[0].unionByName(parts[1])


@query("report_compliance", " UNION ALL ".join(f"SELECT '{n}' AS framework, count(*) AS total_controls, count(*) FILTER (WHERE covered) AS covered_controls, round(count(*) FILTER (WHERE covered) / count(*) * 100, 1) AS coverage_pct FROM {_matrix(t)} x" for n, t in (("nist", fixed.NIST_BY_TECHNIQUE), ("pci-dss", fixed.PCI_BY_TECHNIQUE))))
def report_compliance(lake):
    parts = [rp.compliance_summary(rp.compliance_matrix(lake.rules, f)).select(F.lit(f).alias("framework"), "*") for f in ("nist", "pci-dss")]
    return parts[0].unionByName(parts[1])


_BYT = ", ".join(f"('{t}', '{f}', '{c}')" for t, n, p in fixed.CONTROLS_BY_TACTIC for f, cs in (("nist", n), ("pci-dss", p)) for c in cs.split())


@query("control_detection_counts", f"SELECT framework, control_id, count(*) AS detections, string_agg(DISTINCT d.tactic, ',' ORDER BY d.tactic) AS tactics FROM (VALUES {_BYT}) m(tactic, framework, control_id) JOIN v_detections d ON d.tactic = m.tactic GROUP BY 1, 2")
def control_detection_counts(lake):
    return rp.control_detection_counts(lake.detections)


_LIVE = "(enabled AND id % 10 NOT IN (5, 2) AND hit_count % 10 NOT IN (5, 2))"
_RT = f"(SELECT {_LIVE} AS live, trim(unnest(CAST(json(technique_ids) AS VARCHAR[]))) AS technique FROM v_rules WHERE technique_ids LIKE '[%') rt WHERE technique <> ''"


@query("hunt_suggestions", f"""WITH act0 AS (SELECT technique_id, technique_name, tactic, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h FROM v_detections
  WHERE technique_id IS NOT NULL AND time_us >= {NOW_US - 3 * DAY_US} GROUP BY technique_id, technique_name, tactic, tactic_id),
 act AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY technique_id ORDER BY n DESC, tactic DESC) AS rn FROM act0) t WHERE rn = 1), rc AS (SELECT technique, count(*) AS r FROM {_RT} AND live GROUP BY 1),
 gap AS (SELECT technique FROM {_RT} GROUP BY 1 HAVING NOT bool_or(live)), pure AS (SELECT technique FROM gap WHERE technique NOT IN (SELECT technique_id FROM act)),
 b AS (SELECT technique_id, technique_name, tactic, n AS count, c AS critical, h AS high, coalesce(r, 0) AS rule_count, gap.technique IS NOT NULL AS g FROM act LEFT JOIN rc ON rc.technique = technique_id LEFT JOIN gap ON gap.technique = technique_id
  UNION ALL SELECT technique, technique, 'Unknown', 0, 0, 0, 0, true FROM pure)
 SELECT technique_id, technique_name, tactic, count, critical, high, rule_count, CASE WHEN critical > 0 OR (count > 0 AND rule_count = 0) THEN 'high' WHEN high > 0 OR count > 0 THEN 'medium' ELSE 'low' END AS priority,
 CASE WHEN g AND count > 0 THEN concat(count, ' detection', CASE WHEN count <> 1 THEN 's' ELSE '' END, ' in window with no active rule coverage — manual hunting recommended') WHEN g THEN 'No active Sigma rule coverage — technique is a blind spot; manual hunting required'
  ELSE concat_ws('; ', CASE WHEN count > 0 THEN concat(count, ' detection', CASE WHEN count <> 1 THEN 's' ELSE '' END, ' in analysis window') END, CASE WHEN critical > 0 THEN concat(critical, ' critical-severity') END, CASE WHEN high > 0 THEN concat(high, ' high-severity') END,
  CASE WHEN rule_count = 0 THEN 'no active rule coverage' WHEN rule_count = 1 THEN '1 active rule' ELSE concat(rule_count, ' active rules') END) END AS reason, concat('Hunt ', technique_id, ': ', technique_name, '|', technique_id, '|All ', tactic, ' activity|', tactic) AS queries FROM b
 ORDER BY CASE WHEN critical > 0 OR (count > 0 AND rule_count = 0) THEN 0 WHEN high > 0 OR count > 0 THEN 1 ELSE 2 END, count DESC, technique_id LIMIT 16""")
def hunt_suggestions(lake):
    rules = lake.rules.withColumn("enabled", F.expr(_LIVE))
    out = rp.hunt_suggestions(lake.detections, rules, NOW_US - 3 * DAY_US, limit=16)
    return out.withColumn("queries", F.array_join(F.transform("queries", lambda q: F.concat_ws("|", q["label"], q["query"])), "|"))


_PER = f"(SELECT * FROM v_detections WHERE time_us BETWEEN {NOW_US - 8 * DAY_US} AND {NOW_US})"


@query("report_detections", f"SELECT 'severity' AS dim, severity AS value, count(*) AS n, (SELECT count(*) FROM v_detections WHERE time_us BETWEEN {NOW_US - 8 * DAY_US} AND {NOW_US}) > 500 AS truncated FROM {_PER} a GROUP BY 2 UNION ALL SELECT 'tactic', tactic, count(*), (SELECT count(*) FROM v_detections WHERE time_us BETWEEN {NOW_US - 8 * DAY_US} AND {NOW_US}) > 500 FROM {_PER} b GROUP BY 2")
def report_detections(lake):
    return rp.report_detections(lake.detections, NOW_US - 8 * DAY_US, NOW_US)[1]


@query("report_incidents", f"SELECT id, severity, status, round(ttd_seconds / 3600, 4) AS ttd_hours, round(ttr_seconds / 3600, 4) AS ttr_hours FROM v_incidents WHERE created_us BETWEEN {NOW_US - 8 * DAY_US} AND {NOW_US}")
def report_incidents(lake):
    period = lake.incidents.where(F.col("created_us").between(NOW_US - 8 * DAY_US, NOW_US))
    return period.select("id", "severity", "status", F.round(F.col("ttd_seconds") / 3600, 4).alias("ttd_hours"), F.round(F.col("ttr_seconds") / 3600, 4).alias("ttr_hours"))


@query("report_exec", f"SELECT 'detections' AS card, CAST(count(*) FILTER (WHERE time_us >= {NOW_US - 7 * DAY_US}) AS DOUBLE) AS value FROM v_detections UNION ALL SELECT 'open_incidents', count(*) FILTER (WHERE status NOT IN ('resolved','closed')) FROM v_incidents UNION ALL SELECT 'covered_techniques', count(DISTINCT technique) FROM {_TECH} AND enabled UNION ALL SELECT 'active_rules', count(*) FILTER (WHERE enabled) FROM v_rules")
def report_exec(lake):
    """Executive cards from the same aggregates as the dashboard."""
    def card(name, df, col):
        return df.select(F.lit(name).alias("card"), F.col(col).cast("double").alias("value"))

    parts = [card("detections", m.kpi_detections(lake.detections, NOW_US - 7 * DAY_US, NOW_US, NOW_US - DAY_US), "current"),
             card("open_incidents", m.incident_metrics(lake.incidents, NOW_US, NOW_US), "open"), card("covered_techniques", m.coverage_rules(lake.rules), "covered"),
             card("active_rules", lake.rules.agg(F.count_if("enabled").alias("n")), "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("report_coverage", f"SELECT t.technique AS technique_id, count(*) AS rules, max(coalesce(d.n, 0)) AS detections FROM (SELECT * FROM {_TECH} AND enabled) t LEFT JOIN (SELECT technique_id, count(*) AS n FROM v_detections GROUP BY 1) d ON d.technique_id = t.technique GROUP BY 1")
def report_coverage(lake):
    seen = lake.detections.groupBy("technique_id").agg(F.count("*").alias("detections"))
    return m.rules_per_technique(lake.rules).join(seen, "technique_id", "left").na.fill({"detections": 0})


# ------------------------------------------------------------------------------------- incidents

_LINK = "(SELECT id AS incident_id, unnest(detection_ids) AS detection_id, generate_subscripts(detection_ids, 1) - 1 AS pos FROM v_incidents)"


@query("incident_detail", f"SELECT i.id, greatest(0, (coalesce(closed_us, {NOW_US}) - created_us) // 1000000) AS duration_s, coalesce(x.ids, '') AS detections FROM v_incidents i LEFT JOIN (SELECT incident_id, string_agg(CAST(detection_id AS STRING), ',' ORDER BY pos) AS ids FROM {_LINK} l JOIN v_detections d ON d.id = l.detection_id GROUP BY 1) x ON x.incident_id = i.id")
def incident_detail(lake):
    ids = F.array_join(F.transform(F.coalesce("detections", F.array()), lambda s: s["detection_id"].cast("string")), ",")
    return inc.detail(lake.incidents, lake.detections, NOW_US).select("id", "duration_s", ids.alias("detections"))


def _ord(col):
    return f"(SELECT incident_id, string_agg(v, ',' ORDER BY p) AS vals FROM (SELECT incident_id, {col} AS v, min(pos) AS p FROM {_LINK} l JOIN v_detections d ON d.id = l.detection_id WHERE {col} IS NOT NULL GROUP BY 1, 2) q GROUP BY 1)"


@query("incident_from_detections", f"SELECT h.incident_id, coalesce(t.vals, '') AS techniques, a.vals AS tactics, h.vals AS hosts FROM {_ord('host')} h JOIN {_ord('tactic')} a ON a.incident_id = h.incident_id LEFT JOIN {_ord('technique_id')} t ON t.incident_id = h.incident_id")
def incident_from_detections(lake):
    out = inc.from_detections(lake.incidents, lake.detections)
    return out.select("incident_id", *[F.array_join(c, ",").alias(n) for c, n in (("technique_ids", "techniques"), ("tactics", "tactics"), ("hosts", "hosts"))])


@query("incidents_by_detection", "SELECT id, title FROM v_incidents WHERE list_contains(detection_ids, 42) OR list_contains(detection_ids, 63)")
def incidents_by_detection(lake):
    return lake.incidents.where(F.array_contains("detection_ids", 42) | F.array_contains("detection_ids", 63)).select("id", "title")


@query("incident_open_lookup", f"""SELECT id, incident_id FROM (SELECT d.id, i.id AS incident_id, row_number() OVER (PARTITION BY d.id ORDER BY i.created_us DESC, i.id DESC) AS rn FROM v_detections d JOIN v_incidents i ON list_contains(i.hosts, d.host) AND list_contains(i.tactic_ids, d.tactic)
 AND i.status NOT IN ('resolved','closed') AND i.created_us <= d.time_us AND d.time_us - i.created_us <= {HOUR_US}) t WHERE rn = 1""")
def incident_open_lookup(lake):
    return inc.open_lookup(lake.detections, lake.incidents, HOUR_US)


@query("incident_timeline", "SELECT id, created_us AS at, 'created' AS what FROM v_incidents UNION ALL SELECT id, closed_us, 'closed' FROM v_incidents WHERE closed_us IS NOT NULL")
def incident_timeline(lake):
    return inc.timeline(lake.incidents)


@query("incident_transition", """WITH l AS (SELECT o_custkey AS incident_id, id AS change_id, created_us AS at_us, status, CASE status WHEN 'new' THEN 1 WHEN 'investigating' THEN 2 WHEN 'contained' THEN 3 WHEN 'resolved' THEN 4 ELSE 5 END AS r FROM v_incidents JOIN orders ON o_orderkey = id),
 w AS (SELECT *, max(r) OVER (PARTITION BY incident_id ORDER BY at_us, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM l),
 v AS (SELECT *, coalesce(r >= b, true) AS valid FROM w), e AS (SELECT *, min(CASE WHEN r >= 4 AND valid THEN at_us END) OVER (PARTITION BY incident_id) AS f FROM v)
 SELECT incident_id, change_id, at_us, status, CASE b WHEN 1 THEN 'new' WHEN 2 THEN 'investigating' WHEN 3 THEN 'contained' WHEN 4 THEN 'resolved' WHEN 5 THEN 'closed' END AS previous, valid, CASE WHEN r >= 4 AND valid AND at_us = f THEN at_us END AS closed_us FROM e""")
def incident_transition(lake):
    """A change log (here: the rows of one customer) read as status moves."""
    log = lake.incidents.join(lake.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("incident_id")), "id")
    return inc.transitions(log.select("incident_id", F.col("id").alias("change_id"), F.col("created_us").alias("at_us"), "status"))


# ------------------------------------------------------------------------------------- reduction


@query("conn_rollup", "SELECT dst_ip, dst_port, protocol, time_us // 600000000 AS bucket, count(*) AS flows, count(DISTINCT src_ip) AS sources, CAST(sum(bytes_in + bytes_out) AS BIGINT) AS bytes, min(time_us) AS first_us, max(time_us) AS last_us FROM v_flows GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2")
def conn_rollup(lake):
    return ro.conn_rollup(lake.flows, 10, 2)


@query("file_rollup", "SELECT pattern, action, events, first_us, last_us, array_to_string(s[1:5], ',') AS samples FROM (SELECT regexp_replace(path, '[0-9]+', '*', 'g') AS pattern, action, count(*) AS events, min(time_us) AS first_us, max(time_us) AS last_us, list_sort(list(DISTINCT path)) AS s FROM (SELECT concat('/var/', event_type, '/log', user_id, '.', k) AS path, source AS action, time_us FROM v_events) a GROUP BY 1, 2) t")
def file_rollup(lake):
    files = lake.events.select(F.concat(F.lit("/var/"), "event_type", F.lit("/log"), "user_id", F.lit("."), "k").alias("path"), F.col("source").alias("action"), "time_us")
    return ro.file_rollup(files).withColumn("samples", F.array_join("samples", ","))


@query("conn_state_changes", """SELECT flow_id, state, previous, bytes_so_far FROM (SELECT flow_id, state, lag(state) OVER w AS previous, CAST(sum(bytes_in + bytes_out) OVER w AS BIGINT) AS bytes_so_far FROM v_flows WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY time_us, flow_id)) t WHERE previous IS NULL OR previous <> state""")
def conn_state_changes(lake):
    return ro.state_changes(lake.flows, ["src_ip", "dst_ip"]).select("flow_id", "state", "previous", "bytes_so_far")


@query("adaptive_sample")
def adaptive_sample(lake):
    """Hash-based thinning; the rate part is checked in adaptive_rate."""
    return ro.adaptive_sample(lake.events, ["event_type"]).select("id", "event_type", "nth", "rate")


@query("adaptive_rate", "SELECT id, CASE WHEN n <= 100 THEN 1000 WHEN n <= 1000 THEN 500 WHEN n <= 10000 THEN 100 ELSE 10 END AS rate FROM (SELECT id, row_number() OVER (PARTITION BY event_type ORDER BY time_us, id) AS n FROM v_events) t")
def adaptive_rate(lake):
    from wardlake.operators.timeline import running_sum

    run = running_sum(lake.events, ["event_type"], ["id"], "time_us", {"n": F.lit(1).cast("long")}, HOUR_US)
    n = F.col("n")
    return run.select("id", F.when(n <= 100, 1000).when(n <= 1000, 500).when(n <= 10000, 100).otherwise(10).alias("rate"))


@query("stratified_sample")
def stratified_sample(lake):
    return ro.stratified_sample(lake.events.withColumn("priority", F.col("severity_id") - 1), "priority").select("id", "priority", "rate")


@query("sequence_chain", f"""SELECT DISTINCT c.host, (SELECT max(a.time_us) FROM v_detections a JOIN v_detections b ON b.host = a.host AND b.technique_id = 'T1003.001' AND b.time_us > a.time_us WHERE a.host = c.host AND a.technique_id = 'T1078' AND b.time_us < c.time_us AND c.time_us - a.time_us <= {DAY_US}) AS start_us, c.time_us AS end_us
 FROM v_detections c WHERE c.technique_id = 'T1082' AND start_us IS NOT NULL""")
def sequence_chain(lake):
    return ro.sequence_chain(lake.detections, "host", ["T1078", "T1003.001", "T1082"], DAY_US)


@query("threshold_rule", f"SELECT DISTINCT hostname, time_us, events FROM (SELECT hostname, time_us, count(*) OVER (PARTITION BY hostname ORDER BY time_us RANGE BETWEEN {6 * HOUR_US - 1} PRECEDING AND CURRENT ROW) AS events FROM v_events WHERE event_type = 'error' AND hostname IS NOT NULL) t WHERE events >= 3")
def threshold_rule(lake):
    return ro.threshold_rule(lake.events.where("event_type = 'error' AND hostname IS NOT NULL"), ["hostname"], 6 * HOUR_US, 3)


@query("value_count_rule", f"SELECT DISTINCT hostname, time_us, values FROM (SELECT hostname, time_us, count(DISTINCT dst_ip) OVER (PARTITION BY hostname ORDER BY time_us RANGE BETWEEN {12 * HOUR_US - 1} PRECEDING AND CURRENT ROW) AS values FROM v_events WHERE hostname IS NOT NULL) t WHERE values >= 6")
def value_count_rule(lake):
    return ro.value_count_rule(lake.events.where("hostname IS NOT NULL"), ["hostname"], "dst_ip", 12 * HOUR_US, 6)


@query("baseline_zscore", """SELECT source, hour, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM (SELECT *, avg(n) OVER w AS mean, stddev_pop(n) OVER w AS sd, count(*) OVER w AS c FROM (SELECT source, time_us // 3600000000 AS hour, count(*) AS n FROM v_events GROUP BY 1, 2) a
 WINDOW w AS (PARTITION BY source ORDER BY hour RANGE BETWEEN 168 PRECEDING AND 1 PRECEDING)) b WHERE c > 1 AND sd > 0 AND n > mean + 2.0 * sd""")
def baseline_zscore(lake):
    per = lake.events.groupBy("source", F.floor(F.col("time_us") / HOUR_US).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return ro.baseline_zscore(per, ["source"], "hour", "n", 168, 2.0).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("monitor_conn", "SELECT flow_id FROM v_flows WHERE dst_ip LIKE '45.%' OR dst_port IN (4444,5555,6666,8888,1337,31337) OR dst_port < 1024")
def monitor_conn(lake):
    return ro.monitor_conn(lake.flows).select("flow_id")


_HITS = f"(SELECT t.rule_id, CASE WHEN e.class_uid BETWEEN 4001 AND 4003 THEN e.dst_ip ELSE e.hostname END AS target, count(*) AS n FROM ({DETECT_SQL}) t JOIN v_events e ON e.id = t.id GROUP BY 1, 2)"


def _targets(per_rule):
    return f"SELECT rule_id, target, n, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, target) AS rn FROM {_HITS} h WHERE target IS NOT NULL) t WHERE rn <= {per_rule}"


@query("target_counts", _targets(50))
def target_counts(lake):
    return ro.top_targets(rl.detect(lake.events, RULES), 50)


@query("top_targets", _targets(10))
def top_targets(lake):
    return ro.top_targets(rl.detect(lake.events, RULES), 10)
