"""Lists, lookups and maintenance of the asset, indicator, rule, detection and incident tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardlake.operators import dated
from wardlake.operators import search as s
from wardlake.operators import tables as t
from wardlake.plans.registry import query
from wardlake.plans.views import DAY_US, NOW_US

# ------------------------------------------------------------------------------------- lists

_DET = "id, severity, status, tactic, host, technique_id, score"


@query("list_detections", f"""SELECT {_DET}, count(*) OVER () AS matches FROM v_detections WHERE severity IN ('critical','high') AND status IN ('active') AND lower(tactic) LIKE '%access%' AND lower(host) LIKE '%host-1%'
 AND (lower(name) LIKE '%rule%' OR lower(technique_id) LIKE '%rule%' OR lower(host) LIKE '%rule%' OR lower(username) LIKE '%rule%') ORDER BY score DESC, id LIMIT 25 OFFSET 25""")
def list_detections(lake):
    hit = lake.detections.where(
        F.col("severity").isin("critical", "high") & F.col("status").isin("active") & s.contains_ci(F.col("tactic"), "access")
        & s.contains_ci(F.col("host"), "host-1") & s.text_search("rule", ["name", "technique_id", "host", "username"]))
    rows = s.page(hit, [F.desc("score"), F.asc("id")], 25, 25)
    return rows.select(*_DET.split(", "), hit.agg(F.count("*")).scalar().alias("matches"))


@query("list_incidents", """SELECT id, severity, status, created_us FROM v_incidents WHERE severity IN ('critical','high','medium') AND assigned_to = 'analyst-1'
 ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, CASE status WHEN 'new' THEN 0 WHEN 'investigating' THEN 1 WHEN 'contained' THEN 2 WHEN 'resolved' THEN 3 ELSE 4 END, created_us DESC, id LIMIT 50""")
def list_incidents(lake):
    def rank(c, order):
        return F.coalesce(*[F.when(F.col(c) == v, F.lit(i)) for i, v in enumerate(order)], F.lit(len(order)))

    hit = lake.incidents.where(F.col("severity").isin("critical", "high", "medium") & (F.col("assigned_to") == "analyst-1"))
    order = [rank("severity", ["critical", "high", "medium"]), rank("status", ["new", "investigating", "contained", "resolved"]), F.desc("created_us"), F.asc("id")]
    return s.page(hit, order, 50).select("id", "severity", "status", "created_us")


@query("list_assets", "SELECT id, hostname, criticality, asset_type FROM v_assets WHERE asset_type = 'server' AND is_active AND criticality >= 3 AND (hostname LIKE '%-1%' OR department LIKE '%-1%') ORDER BY criticality DESC, id LIMIT 40")
def list_assets(lake):
    where = (F.col("asset_type") == "server") & F.col("is_active") & (F.col("criticality") >= 3) & s.text_search("-1", ["hostname", "department"])
    return s.page(lake.assets.where(where), [F.desc("criticality"), F.asc("id")], 40).select("id", "hostname", "criticality", "asset_type")


@query("list_iocs", "SELECT id, ioc_type, value, severity FROM v_iocs WHERE ioc_type = 'domain' AND is_active AND value LIKE '%example%' ORDER BY created_us DESC, id LIMIT 30")
def list_iocs(lake):
    where = (F.col("ioc_type") == "domain") & F.col("is_active") & s.text_search("example", ["value"])
    return s.page(lake.iocs.where(where), [F.desc("created_us"), F.asc("id")], 30).select("id", "ioc_type", "value", "severity")


@query("list_audit", "SELECT id, username AS actor, event_type AS action, time_us FROM v_events WHERE event_type IN ('signup','purchase') AND username = 'user-7' AND time_us >= 1704500000000000 ORDER BY time_us DESC, id LIMIT 50")
def list_audit(lake):
    where = F.col("event_type").isin("signup", "purchase") & (F.col("username") == "user-7") & (F.col("time_us") >= 1704500000000000)
    return s.page(lake.events.where(where), [F.desc("time_us"), F.asc("id")], 50).select("id", F.col("username").alias("actor"), F.col("event_type").alias("action"), "time_us")


@query("list_suppressions", "SELECT id, rule_id, host, hit_count FROM v_suppressions WHERE is_active AND (expires_us IS NULL OR expires_us > 1706659200000000) ORDER BY hit_count DESC, id LIMIT 20")
def list_suppressions(lake):
    where = F.col("is_active") & (F.col("expires_us").isNull() | (F.col("expires_us") > NOW_US))
    return s.page(lake.suppressions.where(where), [F.desc("hit_count"), F.asc("id")], 20).select("id", "rule_id", "host", "hit_count")


@query("list_rules", "SELECT id, title, level FROM v_rules WHERE enabled AND level = 'high' ORDER BY created_us DESC, id LIMIT 30")
def list_rules(lake):
    return s.page(lake.rules.where("enabled AND level = 'high'"), [F.desc("created_us"), F.asc("id")], 30).select("id", "title", "level")


@query("recent_detections", "SELECT id, severity, time_us, host FROM v_detections WHERE severity IN ('critical','high') ORDER BY time_us DESC, id LIMIT 20")
def recent_detections(lake):
    return s.page(lake.detections.where(F.col("severity").isin("critical", "high")), [F.desc("time_us"), F.asc("id")], 20).select("id", "severity", "time_us", "host")


# ------------------------------------------------------------------------------------- indicators


@query("ioc_validate", """SELECT id, ioc_type, valid FROM (SELECT id, ioc_type, CASE ioc_type WHEN 'ip' THEN regexp_full_match(value, '([0-9]{1,3}\\.){3}[0-9]{1,3}') AND id % 9 <> 0 WHEN 'hash_md5' THEN id % 9 <> 0 WHEN 'hash_sha256' THEN id % 9 <> 0 WHEN 'url' THEN id % 9 <> 0
 WHEN 'domain' THEN regexp_full_match(value, '([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{2,}') AND id % 9 <> 0 END AS valid FROM v_iocs) t""")
def ioc_validate(lake):
    from wardlake.functions.indicators import is_valid_ioc

    spoiled = F.when(F.col("id") % 9 == 0, F.concat("value", F.lit(" !"))).otherwise(F.col("value"))
    return lake.iocs.select("id", "ioc_type", is_valid_ioc(F.col("ioc_type"), spoiled).alias("valid"))


@query("ioc_lookup", "SELECT id, ioc_type, value FROM v_iocs WHERE ioc_type = 'ip' AND value IN ('45.33.32.4', '192.168.1.7', '9.9.9.9')")
def ioc_lookup(lake):
    return lake.iocs.where((F.col("ioc_type") == "ip") & F.col("value").isin("45.33.32.4", "192.168.1.7", "9.9.9.9")).select("id", "ioc_type", "value")


@query("ioc_bulk_lookup", "SELECT id, value FROM v_iocs WHERE ioc_type = 'ip' AND value IN (SELECT dst_ip FROM v_events)")
def ioc_bulk_lookup(lake):
    wanted = lake.events.select(F.col("dst_ip").alias("value")).distinct()
    return lake.iocs.where("ioc_type = 'ip'").join(wanted, "value", "left_semi").select("id", "value")


_NEWI = "(SELECT min(id) AS id, dst_ip AS value FROM v_events GROUP BY 2 HAVING dst_ip NOT IN (SELECT value FROM v_iocs WHERE ioc_type = 'ip')) t"


@query("ioc_bulk_import", f"SELECT id, 'ip' AS ioc_type, value FROM {_NEWI}")
def ioc_bulk_import(lake):
    """New (type, value) pairs, first of each pair in the batch."""
    batch = lake.events.select("id", F.lit("ip").alias("ioc_type"), F.col("dst_ip").alias("value"))
    return t.insert_new(lake.iocs.select("ioc_type", "value"), batch, ["ioc_type", "value"], "id")


@query("ioc_import_counts", f"SELECT (SELECT count(*) FROM {_NEWI}) AS created, (SELECT count(*) FROM v_events) - (SELECT count(*) FROM {_NEWI}) AS skipped")
def ioc_import_counts(lake):
    batch = lake.events.select("id", F.lit("ip").alias("ioc_type"), F.col("dst_ip").alias("value"))
    return t.import_counts(batch, t.insert_new(lake.iocs.select("ioc_type", "value"), batch, ["ioc_type", "value"], "id"))


@query("expire_iocs", f"""SELECT id, is_active AND NOT (coalesce(expires_us <= {NOW_US}, false) OR coalesce(coalesce(last_hit_us, created_us) < {NOW_US} - 90 * {DAY_US}, false)) AS is_active FROM v_iocs""")
def expire_iocs(lake):
    return t.expire_iocs(lake.iocs, NOW_US).select("id", "is_active")


@query("increment_hits", """SELECT i.id, i.hit_count + coalesce(h.n, 0) AS hit_count, greatest(i.last_hit_us, h.last) AS last_hit_us FROM v_iocs i
 LEFT JOIN (SELECT dst_ip, count(*) AS n, max(time_us) AS last FROM v_events GROUP BY 1) h ON i.value = h.dst_ip""")
def increment_hits(lake):
    hits = lake.events.select(F.col("dst_ip").alias("value"), "time_us")
    return t.increment_hits(lake.iocs, hits, "value", "hit_count", "last_hit_us").select("id", "hit_count", "last_hit_us")


@query("rule_fp_mark", "SELECT r.id, r.fp_count + coalesce(n, 0) AS fp_count FROM v_rules r LEFT JOIN (SELECT user_id AS id, count(*) AS n FROM v_events WHERE event_type = 'error' GROUP BY 1) e ON r.id = e.id")
def rule_fp_mark(lake):
    marks = lake.events.where("event_type = 'error'").select(F.col("user_id").alias("id"), "time_us")
    return t.increment_hits(lake.rules, marks, "id", "fp_count").select("id", "fp_count")


# ------------------------------------------------------------------------------------- assets


@query("asset_bulk_import", "SELECT min(id) AS id, hostname FROM v_events WHERE hostname IS NOT NULL AND hostname NOT IN (SELECT hostname FROM v_assets WHERE criticality > 2) GROUP BY 2")
def asset_bulk_import(lake):
    known = lake.assets.where("criticality > 2")
    return t.insert_new(known, lake.events.where("hostname IS NOT NULL").select("id", "hostname"), ["hostname"], "id")


@query("asset_upsert", """SELECT coalesce(a.hostname, e.hostname) AS hostname, coalesce(e.department, a.department) AS department, coalesce(e.criticality, a.criticality) AS criticality FROM v_assets a FULL JOIN
 (SELECT hostname, max(username) AS department, CAST(NULL AS INT) AS criticality FROM v_events WHERE hostname IS NOT NULL GROUP BY 1) e ON a.hostname = e.hostname""")
def asset_upsert(lake):
    new = lake.events.where("hostname IS NOT NULL").groupBy("hostname").agg(F.max("username").alias("department"), F.lit(None).cast("int").alias("criticality"))
    return t.patch(lake.assets, new, "hostname", ["department", "criticality"])


_IPS = "(SELECT id, hostname, criticality, unnest(ip_addresses) AS ip FROM v_assets)"


@query("asset_criticality", f"""SELECT h.host, coalesce(a.criticality, p.crit, 3) AS criticality, (coalesce(a.criticality, p.crit, 3) - 1) / 4 AS scale FROM (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN hostname ELSE src_ip END AS host FROM v_events) h
 LEFT JOIN (SELECT hostname, max(criticality) AS criticality FROM v_assets GROUP BY 1) a ON a.hostname = h.host LEFT JOIN (SELECT ip, max(criticality) AS crit FROM {_IPS} t GROUP BY 1) p ON p.ip = h.host WHERE h.host IS NOT NULL""")
def asset_criticality(lake):
    from wardlake.operators.enrich import asset_criticality as crit

    hosts = lake.events.select(F.when(F.col("id") % 2 == 0, F.col("hostname")).otherwise(F.col("src_ip")).alias("host")).where("host IS NOT NULL").distinct()
    return crit(hosts, lake.assets).withColumn("scale", (F.col("criticality") - 1) / 4)


@query("asset_detections", "SELECT a.hostname, count(*) AS detections, max(d.time_us) AS last_us FROM v_assets a JOIN v_detections d ON d.host = a.hostname GROUP BY 1")
def asset_detections(lake):
    """Detections per asset; counted per host before the join."""
    per = lake.detections.groupBy(F.col("host").alias("hostname")).agg(F.count("*").alias("detections"), F.max("time_us").alias("last_us"))
    return per.join(lake.assets.select("hostname"), "hostname")


@query("asset_incidents", "SELECT a.hostname, count(*) AS incidents FROM v_assets a JOIN (SELECT DISTINCT id, unnest(hosts) AS host FROM v_incidents) i ON i.host = a.hostname GROUP BY 1")
def asset_incidents(lake):
    per = lake.incidents.select("id", F.explode(F.array_distinct("hosts")).alias("hostname")).groupBy("hostname").agg(F.count("*").alias("incidents"))
    return per.join(lake.assets.select("hostname"), "hostname")


@query("asset_discover", """SELECT host AS hostname, max(time_us) AS last_seen_us, arg_max(ip, time_us) AS ip FROM (
 SELECT coalesce(hostname, CASE WHEN source = 'Wazuh' THEN NULL ELSE src_ip END) AS host, src_ip AS ip, time_us FROM v_events WHERE source <> 'Wazuh' AND src_ip LIKE '10.%'
 UNION ALL SELECT dst_ip, dst_ip, time_us FROM v_events WHERE source <> 'Wazuh' AND dst_ip LIKE '192.168.%' UNION ALL SELECT dst_ip, dst_ip, time_us FROM v_events WHERE source = 'Wazuh') t WHERE host IS NOT NULL GROUP BY 1""")
def asset_discover(lake):
    from wardlake.operators.enrich import discover_assets

    return discover_assets(lake.events)


# ------------------------------------------------------------------------------------- upkeep


@query("upsert_events", "SELECT id % 4000 AS id, arg_max(summary, time_us) AS summary, max(time_us) AS time_us FROM v_events GROUP BY 1")
def upsert_events(lake):
    """INSERT OR REPLACE by id, last write wins."""
    ev = lake.events.select((F.col("id") % 4000).alias("id"), "summary", "time_us")
    stored = t.last_write_wins(ev.where("time_us < 1705500000000000"), ["id"], F.col("time_us"))
    return t.upsert(stored, ev.where("time_us >= 1705500000000000"), ["id"], "time_us")


@query("bulk_status_update", "SELECT count(d.id) AS updated, count(*) FILTER (WHERE d.id IS NULL) AS not_found FROM (SELECT DISTINCT unnest(detection_ids) AS id FROM v_incidents) w LEFT JOIN v_detections d ON d.id = w.id")
def bulk_status_update(lake):
    want = lake.incidents.select(F.explode("detection_ids").alias("want")).distinct()
    return want.join(lake.detections.select("id"), F.col("want") == F.col("id"), "left").agg(F.count("id").alias("updated"), F.count_if(F.col("id").isNull()).alias("not_found"))


@query("retention_delete", f"""SELECT 'detections' AS tbl, count(*) AS kept FROM v_detections WHERE time_us >= {NOW_US} - 20 * {DAY_US} UNION ALL
 SELECT 'incidents', count(*) FROM v_incidents WHERE NOT (status IN ('resolved','closed') AND coalesce(closed_us < {NOW_US} - 15 * {DAY_US}, false)) UNION ALL SELECT 'iocs', count(*) FROM v_iocs WHERE NOT coalesce(expires_us < {NOW_US} - 2 * {DAY_US}, false)""")
def retention_delete(lake):
    old = t.retention_predicates(NOW_US, 20, 15, 2)
    parts = [getattr(lake, n).where(~p).agg(F.lit(n).alias("tbl"), F.count("*").alias("kept")) for n, p in old.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _stored(lake, name: str, columns: list[str], time_us: str) -> str:
    """A view as a table by day, under a name of its own."""
    table = f"wardlake_{name}_{uuid.uuid4().hex}"
    dated.create(getattr(lake, name).select(*columns), table, "id", time_us)
    return table


@query("retention_apply", f"""SELECT 'detections' AS tbl, id FROM v_detections WHERE time_us >= {NOW_US} - 20 * {DAY_US} UNION ALL
 SELECT 'incidents', id FROM v_incidents WHERE NOT (status IN ('resolved','closed') AND coalesce(closed_us < {NOW_US} - 15 * {DAY_US}, false)) UNION ALL SELECT 'iocs', id FROM v_iocs WHERE NOT coalesce(expires_us < {NOW_US} - 2 * {DAY_US}, false)""")
def retention_apply(lake):
    """The stored tables after retention: only days that hold an old row are written again."""
    columns = {"detections": ["id", "time_us", "severity", "status"], "incidents": ["id", "created_us", "status", "closed_us"], "iocs": ["id", "created_us", "value", "expires_us"]}
    out = []
    for name, old in t.retention_predicates(NOW_US, 20, 15, 2).items():
        table = _stored(lake, name, columns[name], columns[name][1])
        dated.delete_rows(lake.spark, table, old)
        out.append(lake.spark.table(table).select(F.lit(name).alias("tbl"), F.col("id").cast("long").alias("id")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("bulk_status_apply", """SELECT d.id, CASE WHEN w.id IS NOT NULL THEN 'resolved' ELSE d.status END AS status, d.severity FROM v_detections d
 LEFT JOIN (SELECT DISTINCT unnest(detection_ids) AS id FROM v_incidents WHERE status = 'resolved') w ON w.id = d.id""")
def bulk_status_apply(lake):
    """The stored detections after those of resolved incidents were set to resolved."""
    table = _stored(lake, "detections", ["id", "time_us", "severity", "status"], "time_us")
    ids = lake.incidents.where("status = 'resolved'").select(F.explode("detection_ids").alias("id"), F.lit("resolved").alias("status"))
    dated.update_rows(lake.spark, table, ids)
    return lake.spark.table(table).select("id", "status", "severity")


@query("tiering", f"SELECT CASE WHEN ({NOW_US} - time_us) // {DAY_US} >= 20 THEN 'delete' WHEN ({NOW_US} - time_us) // {DAY_US} >= 7 THEN 'warm' ELSE 'hot' END AS tier, count(*) AS n FROM v_events GROUP BY 1")
def tiering(lake):
    age = F.floor((F.lit(NOW_US) - F.col("time_us")) / DAY_US)
    return lake.events.groupBy(t.tier(age, 7, 20).alias("tier")).agg(F.count("*").alias("n"))


@query("agent_status", f"SELECT id, CASE WHEN heartbeat_us IS NULL OR {NOW_US} - heartbeat_us >= 600000000 THEN 'offline' WHEN {NOW_US} - heartbeat_us >= 120000000 AND status = 'online' THEN 'degraded' ELSE status END AS status FROM v_agents")
def agent_status(lake):
    return lake.agents.select("id", t.agent_status(F.col("heartbeat_us"), F.col("status"), NOW_US).alias("status"))


@query("inactive_accounts", f"SELECT id, name FROM v_accounts WHERE is_active AND last_login_us < {NOW_US} - 90 * {DAY_US}")
def inactive_accounts(lake):
    return lake.accounts.where(F.col("is_active") & (F.col("last_login_us") < NOW_US - 90 * DAY_US)).select("id", "name")


_CUT = 1705500000000000
_SNAP = "(SELECT concat('/etc/f', user_id, '/', k) AS path, max(summary) AS h FROM v_events WHERE time_us {op} {cut} GROUP BY 1)"


@query("snapshot_diff", f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'Create' WHEN b.path IS NULL THEN 'Delete' ELSE 'Modify' END AS change, a.h AS before, b.h AS after
 FROM {_SNAP.format(op='<', cut=_CUT)} a FULL JOIN {_SNAP.format(op='>=', cut=_CUT)} b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def snapshot_diff(lake):
    """What was seen before a moment against what was seen from it on."""
    ev = lake.events.withColumn("path", F.concat(F.lit("/etc/f"), "user_id", F.lit("/"), "k"))
    before = ev.where(F.col("time_us") < _CUT).groupBy("path").agg(F.max("summary").alias("text"))
    after = ev.where(F.col("time_us") >= _CUT).groupBy("path").agg(F.max("summary").alias("text"))
    return t.snapshot_diff(before, after, "path", "text")


# ------------------------------------------------------------------------------------- set operations


@query("set_intersect", "SELECT technique_id FROM v_detections WHERE technique_id IS NOT NULL INTERSECT SELECT trim(unnest(CAST(json(technique_ids) AS VARCHAR[]))) FROM v_rules WHERE technique_ids LIKE '[%' AND enabled")
def set_intersect(lake):
    from wardlake.operators.metrics import rule_techniques

    seen = lake.detections.select("technique_id").where("technique_id IS NOT NULL")
    return seen.intersect(rule_techniques(lake.rules.where("enabled")).select("technique"))


@query("set_difference", "SELECT technique_id FROM v_detections WHERE technique_id IS NOT NULL EXCEPT SELECT trim(unnest(CAST(json(technique_ids) AS VARCHAR[]))) FROM v_rules WHERE technique_ids LIKE '[%' AND enabled")
def set_difference(lake):
    from wardlake.operators.metrics import rule_techniques

    seen = lake.detections.select("technique_id").where("technique_id IS NOT NULL")
    return seen.subtract(rule_techniques(lake.rules.where("enabled")).select("technique"))


@query("set_union", "SELECT technique_id FROM v_detections WHERE technique_id IS NOT NULL UNION SELECT * FROM (SELECT trim(unnest(CAST(json(technique_ids) AS VARCHAR[]))) AS x FROM v_rules WHERE technique_ids LIKE '[%' AND enabled) t WHERE x <> ''")
def set_union(lake):
    from wardlake.operators.metrics import rule_techniques

    seen = lake.detections.select("technique_id").where("technique_id IS NOT NULL")
    return seen.union(rule_techniques(lake.rules.where("enabled")).select("technique")).distinct()
