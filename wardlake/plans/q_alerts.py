"""Alert handling: dedup, suppression, enrichment, scoring, correlation, routing, escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake.functions import scoring
from wardlake.functions.indicators import confidence_severity
from wardlake.operators import alerts as al
from wardlake.operators import enrich, routing
from wardlake.operators import timeline as tl
from wardlake.plans.q_rules import DETECT_SQL, RULES
from wardlake.plans.registry import query
from wardlake.plans.views import DAY_US, NOW_US
from wardlake.session import settle

HOUR_US = 3_600_000_000


def ttl_sql(source: str, keys: str, ttl: int, ts: str = "time_us") -> str:
    """Kept instants of the greedy chain as a list fold."""
    return f"""(SELECT {keys}, unnest(list_reduce(list_transform(list_sort(list_distinct(ts)), lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[len(a)] >= {ttl} THEN list_concat(a, b) ELSE a END)) AS kept
 FROM (SELECT {keys}, list({ts}) AS ts FROM {source} GROUP BY ALL) g)"""


def _dedup(name: str, source: str, keys: list[str], ttl: int, frame):
    ks = ", ".join(keys)
    on = " AND ".join(f"d.{k} IS NOT DISTINCT FROM k.{k}" for k in keys)
    sql = f"SELECT d.id, {', '.join('d.' + k for k in keys)}, d.time_us FROM {source} d JOIN {ttl_sql(source, ks, ttl)} k ON {on} AND d.time_us = k.kept"

    @query(name, sql)
    def run(lake):
        return tl.first_in_ttl(frame(lake).select("id", *keys, "time_us"), keys, "time_us", "id", ttl)

    return run


_dedup("dedup_alerts", "v_detections", ["rule_name", "host"], 6 * HOUR_US, lambda lk: lk.detections)
_dedup("dedup_notifications", "(SELECT id, severity AS channel, rule_name, host, time_us FROM v_detections)", ["channel", "rule_name", "host"], 12 * HOUR_US, lambda lk: lk.detections.withColumnRenamed("severity", "channel"))
_dedup("dedup_asset_upserts", "v_events", ["hostname"], 2 * HOUR_US, lambda lk: lk.events)
_dedup("dedup_events", "v_events", ["process_name", "event_type"], HOUR_US, lambda lk: lk.events)
_dedup("incident_escalate", "(SELECT id, name, time_us FROM v_detections WHERE severity = 'critical')", ["name"], 24 * HOUR_US, lambda lk: lk.detections.where("severity = 'critical'"))


@query("merge_detections", f"""SELECT d.rule_name, d.host, k.kept AS anchor_us, count(*) AS occurrences, round(least(CASE arg_min(severity, time_us) WHEN 'critical' THEN 9.0 WHEN 'high' THEN 7.0 WHEN 'medium' THEN 5.0 ELSE 3.0 END + least(1.0, log10(count(*)) / 4), 10.0), 4) AS score
 FROM v_detections d JOIN {ttl_sql('v_detections', 'rule_name, host', DAY_US)} k ON d.rule_name IS NOT DISTINCT FROM k.rule_name AND d.host = k.host AND d.time_us >= k.kept AND d.time_us < k.kept + {DAY_US} GROUP BY 1, 2, 3""")
def merge_detections(lake):
    return al.merge_detections(lake.detections, ["rule_name", "host"]).select("rule_name", "host", "anchor_us", "occurrences", F.round("score", 4).alias("score"))


_ELIG = "(SELECT * FROM v_detections WHERE severity IN ('critical', 'high'))"


@query("correlate_incidents", f"""SELECT d.id, d.host, d.tactic, k.kept AS opened_us FROM v_detections d JOIN {ttl_sql(_ELIG, 'host, tactic', 12 * HOUR_US + 1)} k
 ON d.host = k.host AND d.tactic = k.tactic AND d.time_us >= k.kept AND d.time_us <= k.kept + {12 * HOUR_US}""")
def correlate_incidents(lake):
    return al.correlate(lake.detections, 12 * HOUR_US).select("id", "host", "tactic", F.col("anchor_us").alias("opened_us"))


@query("recurrence_24h", f"""SELECT id, coalesce(CAST(count(*) OVER (PARTITION BY rule_name, host ORDER BY time_us // 1000000 RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS recurrence FROM v_detections""")
def recurrence_24h(lake):
    return al.recurrence(lake.detections, ["rule_name", "host"]).select("id", "recurrence")


_SUP = f"""(SELECT d.id, min(s.id) AS suppression_id FROM v_detections d JOIN v_suppressions s ON s.is_active AND (s.expires_us IS NULL OR s.expires_us > {NOW_US}) AND (s.rule_id IS NULL OR s.rule_id = d.rule_name) AND (s.technique_id IS NULL OR s.technique_id = d.technique_id)
 AND (s.tactic IS NULL OR lower(s.tactic) = lower(d.tactic)) AND (s.severity IS NULL OR lower(s.severity) = lower(d.severity)) AND (s.host IS NULL OR lower(d.host) GLOB lower(s.host)) GROUP BY 1)"""


@query("suppress_match", f"SELECT id AS alert_id, suppression_id FROM {_SUP} t")
def suppress_match(lake):
    return enrich.match_suppressions(lake.detections.withColumnRenamed("rule_name", "rule_id"), lake.suppressions, NOW_US)


@query("suppress_alerts", f"SELECT id, host, severity FROM v_detections WHERE id NOT IN (SELECT id FROM {_SUP} t)")
def suppress_alerts(lake):
    det = lake.detections
    hit = enrich.match_suppressions(det.withColumnRenamed("rule_name", "rule_id"), lake.suppressions, NOW_US)
    return det.join(hit, det.id == hit.alert_id, "left_anti").select("id", "host", "severity")


@query("suppress_hits", f"SELECT s.id, s.hit_count + coalesce(n, 0) AS hit_count FROM v_suppressions s LEFT JOIN (SELECT suppression_id, count(*) AS n FROM {_SUP} t GROUP BY 1) h ON h.suppression_id = s.id")
def suppress_hits(lake):
    from wardlake.operators.tables import increment_hits

    hit = enrich.match_suppressions(lake.detections.withColumnRenamed("rule_name", "rule_id"), lake.suppressions, NOW_US)
    return increment_hits(lake.suppressions, hit.select(F.col("suppression_id").alias("id")), "id", "hit_count").select("id", "hit_count")


_CAND = "(SELECT DISTINCT id, ioc_type, value FROM (SELECT id, 'ip' AS ioc_type, src_ip AS value FROM v_artifacts UNION ALL SELECT id, 'ip', dst_ip FROM v_artifacts UNION ALL SELECT id, 'domain', domain FROM v_artifacts UNION ALL SELECT id, 'domain', hostname FROM v_artifacts UNION ALL SELECT id, 'ip', hostname FROM v_artifacts UNION ALL SELECT id, 'hash_md5', process_hash FROM v_artifacts UNION ALL SELECT id, 'hash_sha256', hash_sha256 FROM v_artifacts UNION ALL SELECT id, 'url', url FROM v_artifacts) c0 WHERE length(value) > 0)"
_MATCH = f"(SELECT c.id AS alert_id, i.id AS ioc_id, c.ioc_type, c.value FROM {_CAND} c JOIN v_iocs i ON i.is_active AND i.ioc_type = c.ioc_type AND i.value = c.value)"


@query("ioc_match", f"SELECT alert_id, ioc_id, ioc_type, value FROM {_MATCH} t")
def ioc_match(lake):
    return enrich.ioc_match(lake.artifacts, lake.iocs, enrich.row_candidates(lake.artifacts)).select("alert_id", "ioc_id", "ioc_type", "value")


@query("ti_boost", f"SELECT alert_id, count(*) AS matches, least(count(*) * 1.5, 3.0)::DOUBLE AS boost FROM {_MATCH} t GROUP BY 1")
def ti_boost(lake):
    m = enrich.ioc_match(lake.artifacts, lake.iocs, enrich.row_candidates(lake.artifacts)).groupBy("alert_id").agg(F.count("*").alias("matches"))
    return m.withColumn("boost", enrich.ti_boost(F.col("matches")))


@query("geoip_enrich", """SELECT e.id AS alert_id, CASE WHEN g.id IS NULL THEN e.peer_ip ELSE e.dst_ip END AS ip, coalesce(g.country, h.country) AS country, coalesce(g.country_code, h.country_code) AS country_code
 FROM v_artifacts e LEFT JOIN v_geo g ON e.dst_ip LIKE '45.33.32.%' AND CAST(split_part(e.dst_ip, '.', 4) AS INT) // 8 = g.id LEFT JOIN v_geo h ON h.network = concat('2a00:', e.k, '::/32') AND e.peer_ip IS NOT NULL
 WHERE g.id IS NOT NULL OR h.id IS NOT NULL""")
def geoip_enrich(lake):
    from wardlake.functions.net import public_ips

    return enrich.geo_enrich(lake.artifacts, lake.geo, public_ips(F.col("hostname"), F.col("src_ip"), F.col("dst_ip"), F.col("peer_ip"))).select("alert_id", "ip", "country", "country_code")


@query("risk_score", """SELECT id, CAST(round_even(least(((CAST(severity_id AS DOUBLE) - 1) / 4 * 0.60 + least(value / 487.0::DOUBLE, 1.0) * 0.25 + least((k % 13) / 10.0::DOUBLE, 1.0) * 0.15) * 10.0
 + least((k % 3) * 1.5::DOUBLE, 3.0), 10.0), 1) AS DOUBLE) AS score FROM v_events""")
def risk_score(lake):
    k = F.col("k")
    crit = F.least(F.col("value") / 487.0, F.lit(1.0))
    return lake.events.select("id", scoring.risk_score(F.col("severity_id"), crit, k % 13, enrich.ti_boost(k % 3)).alias("score"))


_ALERT_SQL = f"""(SELECT md5(concat(CAST(id AS STRING), '|', rule_id)) AS alert_id, id AS event_id, time_us, rule_id, sev AS severity_id, coalesce(hostname, dst_ip, '') AS host FROM ({DETECT_SQL}) d0)"""


@query("enrich_alerts", f"""WITH al AS (SELECT a.*, e.src_ip, e.dst_ip, e.domain, e.process_hash, e.hash_sha256, e.url FROM {_ALERT_SQL} a JOIN v_artifacts e ON e.id = a.event_id),
 ac AS (SELECT hostname, max(criticality) AS c FROM v_assets GROUP BY 1), ip AS (SELECT u AS ip, max(criticality) AS c FROM (SELECT unnest(ip_addresses) AS u, criticality FROM v_assets) t GROUP BY 1),
 cand AS (SELECT DISTINCT alert_id, ty, value FROM (SELECT alert_id, 'ip' AS ty, host AS value FROM al UNION ALL SELECT alert_id, 'ip', src_ip FROM al UNION ALL SELECT alert_id, 'ip', dst_ip FROM al UNION ALL SELECT alert_id, 'domain', host FROM al UNION ALL SELECT alert_id, 'domain', domain FROM al UNION ALL SELECT alert_id, 'hash_md5', process_hash FROM al UNION ALL SELECT alert_id, 'hash_sha256', hash_sha256 FROM al UNION ALL SELECT alert_id, 'url', url FROM al) c0),
 m AS (SELECT alert_id, count(*) AS n FROM cand JOIN v_iocs i ON i.is_active AND i.ioc_type = ty AND i.value = cand.value GROUP BY 1)
 SELECT al.alert_id, (coalesce(ac.c, ip.c, 3) - 1) / 4 AS asset_criticality, count(*) OVER (PARTITION BY rule_id, host ORDER BY time_us // 1000000 RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS recurrence,
  CAST(least(coalesce(m.n, 0) * 1.5, 3.0) AS DOUBLE) AS ti_boost, g.country AS geo_country
 FROM al LEFT JOIN ac ON ac.hostname = al.host LEFT JOIN ip ON ip.ip = al.host LEFT JOIN m ON m.alert_id = al.alert_id LEFT JOIN v_geo g ON al.dst_ip LIKE '45.33.32.%' AND CAST(split_part(al.dst_ip, '.', 4) AS INT) // 8 = g.id""")
def enrich_alerts(lake):
    out = al.enrich_alerts(settle(al.rule_alerts(lake.artifacts, RULES)), lake.assets, lake.iocs, lake.geo)
    return out.select("alert_id", "asset_criticality", "recurrence", "ti_boost", "geo_country")


@query("flagship_alerts", f"""SELECT k.rule_id, k.host, k.kept AS time_us, a.event_id, a.severity_id, round(least(((a.severity_id - 1) / 4 * 0.60 + (coalesce(c.c, 3) - 1) / 4 * 0.25) * 10, 10), 3) AS base_score
 FROM {ttl_sql(_ALERT_SQL, 'rule_id, host', 6 * HOUR_US)} k JOIN {_ALERT_SQL} a ON a.rule_id = k.rule_id AND a.host = k.host AND a.time_us = k.kept LEFT JOIN (SELECT hostname, max(criticality) AS c FROM v_assets GROUP BY 1) c ON c.hostname = a.host""")
def flagship_alerts(lake):
    """Events -> rule matches -> first per (rule, host) in each TTL -> asset criticality -> score: every scored alert."""
    alerts = settle(al.rule_alerts(lake.events, RULES).select("event_id", "time_us", "rule_id", "severity_id", "host"))
    kept = tl.first_in_ttl(alerts, ["rule_id", "host"], "time_us", "event_id", 6 * HOUR_US)
    base = ((F.col("severity_id") - 1) / 4 * 0.60 + (F.col("criticality") - 1) / 4 * 0.25) * 10
    return enrich.asset_criticality(kept, lake.assets).select("rule_id", "host", "time_us", "event_id", "severity_id", F.round(F.least(base, F.lit(10.0)), 3).alias("base_score"))


@query("alert_to_detection", f"SELECT a.alert_id AS id, d.technique AS technique_id, d.tactic AS tactic, a.host, a.rule_id AS rule_name FROM {_ALERT_SQL} a JOIN (SELECT DISTINCT rule_id, technique, tactic FROM ({DETECT_SQL}) x) d ON d.rule_id = a.rule_id")
def alert_to_detection(lake):
    return al.alert_to_detection(al.rule_alerts(lake.events, RULES)).select("id", "technique_id", "tactic", "host", "rule_name")


@query("stale_detections", f"""SELECT id, rule_name, host FROM v_detections d WHERE status = 'active' AND rule_name IS NOT NULL AND time_us < {NOW_US - 4 * DAY_US}
 AND NOT EXISTS (SELECT 1 FROM v_detections e WHERE e.rule_name = d.rule_name AND e.host = d.host AND e.time_us >= {NOW_US - 4 * DAY_US})""")
def stale_detections(lake):
    return al.stale(lake.detections, NOW_US - 4 * DAY_US).select("id", "rule_name", "host")


@query("auto_close", f"""SELECT id, CASE WHEN status = 'active' AND rule_name IS NOT NULL AND time_us < {NOW_US - 4 * DAY_US} AND (rule_name, host) NOT IN (SELECT (rule_name, host) FROM v_detections WHERE rule_name IS NOT NULL AND time_us >= {NOW_US - 4 * DAY_US}) THEN 'closed' ELSE status END AS status FROM v_detections""")
def auto_close(lake):
    det = lake.detections
    gone = al.stale(det, NOW_US - 4 * DAY_US).select(F.col("id").alias("_sid"))
    return det.join(gone, F.col("id") == F.col("_sid"), "left").select("id", F.when(F.col("_sid").isNotNull(), "closed").otherwise(F.col("status")).alias("status"))


_ROUTE = """FROM v_detections d JOIN v_channels c ON c.enabled AND (CASE d.severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END) >= (CASE c.min_severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END)
 AND CASE c.id % 8 WHEN 0 THEN true WHEN 1 THEN d.host = concat('host-', c.id) WHEN 2 THEN contains(lower(d.tactic), 'access')
  WHEN 3 THEN coalesce(d.technique_id IN ('T1078', 'T1021.002'), false) OR d.host = concat('host-', c.id) WHEN 4 THEN coalesce(d.rule_name IN ('rule-1', 'rule-2', 'rule-3'), false)
  WHEN 5 THEN d.severity <> 'medium' WHEN 7 THEN d.technique_id <> 'T1003' ELSE false END"""


def _routed(lake):
    return routing.route(lake.detections.withColumns({"tactics": F.array("tactic"), "techniques": F.array_compact(F.array("technique_id"))}), lake.channels, "tactics", "techniques")


@query("routing_match", f"SELECT d.id, c.id AS channel_id {_ROUTE}")
def routing_match(lake):
    return _routed(lake).select("id", "channel_id")


@query("channel_dispatch_plan", f"""WITH r AS (SELECT d.id, d.time_us, d.rule_name, d.host, c.id AS channel_id {_ROUTE})
 SELECT r.id, r.channel_id FROM r JOIN {ttl_sql('r', 'channel_id, rule_name, host', 12 * HOUR_US)} k ON r.channel_id = k.channel_id AND r.rule_name IS NOT DISTINCT FROM k.rule_name AND r.host = k.host AND r.time_us = k.kept""")
def channel_dispatch_plan(lake):
    """Deliveries left after the per (channel, rule, host) rate limit."""
    sent = settle(_routed(lake).select("id", "time_us", "rule_name", "host", "channel_id"))
    return tl.first_in_ttl(sent, ["channel_id", "rule_name", "host"], "time_us", "id", 12 * HOUR_US).select("id", "channel_id")


@query("min_level", "SELECT id, severity FROM v_detections WHERE severity IN ('critical', 'high')")
def min_level(lake):
    return lake.detections.where(scoring.at_least(F.col("severity"), "high")).select("id", "severity")


@query("confidence_severity", "SELECT id, severity FROM v_iocs")
def conf_sev(lake):
    return lake.iocs.select("id", confidence_severity(F.col("confidence")).alias("severity"))


@query("escalation_once", f"""SELECT id, ({NOW_US - 2 * DAY_US} - time_us) // 60000000 AS minutes_active FROM v_detections WHERE status = 'active' AND severity IN ('critical','high') AND time_us <= {NOW_US - 2 * DAY_US} - 1800000000
 AND id NOT IN (SELECT unnest(detection_ids) FROM v_incidents WHERE status <> 'new')""")
def escalation_once(lake):
    """Long-active severe detections not escalated before."""
    now = NOW_US - 2 * DAY_US
    done = lake.incidents.where("status <> 'new'").select(F.explode("detection_ids").alias("id")).distinct()
    due = lake.detections.where((F.col("status") == "active") & F.col("severity").isin("critical", "high") & (F.col("time_us") <= now - 1_800_000_000))
    minutes = F.greatest(F.lit(1), F.floor((F.lit(now) - F.col("time_us")) / 60_000_000)).cast("long")
    return due.join(done, "id", "left_anti").select("id", minutes.alias("minutes_active"))


@query("union_alerts", f"SELECT 'rule' AS kind, alert_id AS id, host FROM {_ALERT_SQL} a UNION ALL SELECT 'flow', flow_id, src_ip FROM v_flows WHERE dst_port = 53 AND bytes_in + bytes_out > 100")
def union_alerts(lake):
    from wardlake.operators.flows import dns_flow_tunnel

    rules_ = al.rule_alerts(lake.events, RULES).select(F.lit("rule").alias("kind"), F.col("alert_id").alias("id"), "host")
    flows = dns_flow_tunnel(lake.flows).select(F.lit("flow").alias("kind"), F.col("flow_id").alias("id"), F.col("src_ip").alias("host"))
    return rules_.unionByName(flows, allowMissingColumns=True)


@query("alerts_jsonl", f"SELECT concat('{{\"event_id\":', CAST(event_id AS STRING), ',\"rule_id\":\"', rule_id, '\",\"host\":\"', host, '\"}}') AS line FROM {_ALERT_SQL} a")
def alerts_jsonl(lake):
    """One JSON document per alert."""
    return al.rule_alerts(lake.events, RULES).select(F.to_json(F.struct("event_id", "rule_id", "host")).alias("line"))
