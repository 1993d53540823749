"""Scans, filters, pages and histograms over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake.functions import net
from wardlake.operators import search as s
from wardlake.plans.registry import query
from wardlake.plans.views import NOW_US

COLS = ["id", "time_us", "class_name", "severity_id", "src_ip", "dst_ip", "hostname", "username", "source", "summary"]
COLS_SQL = ", ".join(COLS)


@query("scan_events_table", f"SELECT {COLS_SQL}, class_uid, process_hash FROM v_events")
def scan(lake):
    return lake.events.select(*COLS, "class_uid", "process_hash")


@query("event_filter", f"""SELECT {COLS_SQL} FROM v_events
 WHERE severity_id >= 3 AND class_uid <> 4002 AND src_ip <> '10.0.0.7' AND lower(hostname) LIKE '%host-1%' AND lower(username) LIKE '%user%' AND severity_id <= 5""")
def event_filter(lake):
    return lake.events.where(s.event_filter([
        ("severity_id", "gte", 3), ("class_uid", "ne", 4002), ("src_endpoint.ip", "ne", "10.0.0.7"), ("hostname", "contains", "HOST-1"),
        ("actor_user.name", "contains", "user"), ("severity_id", "lte", 5), ("drop_table", "eq", 1)])).select(*COLS)


@query("time_range", f"SELECT {COLS_SQL} FROM v_events WHERE time_us BETWEEN 1706054400000000 AND 1706400000000000")
def time_range(lake):
    return lake.events.where(s.time_range("now-7d", "2024-01-28T00:00:00Z", NOW_US)).select(*COLS)


@query("text_search", f"""SELECT {COLS_SQL} FROM v_events WHERE lower(summary) LIKE '%error observed%' OR lower(coalesce(hostname,'')) LIKE '%error observed%'
 OR lower(coalesce(username,'')) LIKE '%error observed%' OR src_ip LIKE '%error observed%' OR dst_ip LIKE '%error observed%'""")
def text_search(lake):
    return lake.events.where(s.text_search("Error OBSERVED")).select(*COLS)


@query("text_search_messages", "SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def text_search_messages(lake):
    """Substring search over whole message texts."""
    docs = lake.table("documents")
    return docs.where(s.text_search("LICENSE", ["text", "source"])).select("doc_id", "source", "n_chars")


@query("token_search", f"""SELECT {COLS_SQL} FROM v_events WHERE
 list_contains(string_split_regex(lower(concat_ws(' ', summary, class_name, hostname, username)), '[^a-z0-9]+'), 'purchase') AND
 list_contains(string_split_regex(lower(concat_ws(' ', summary, class_name, hostname, username)), '[^a-z0-9]+'), '42')""")
def token_search(lake):
    return lake.events.where(s.token_search("Purchase 42")).select(*COLS)


@query("rule_query", f"SELECT {COLS_SQL} FROM v_events WHERE source = 'Zeek' AND severity_id >= 4 AND hostname LIKE 'host-2%' AND class_uid < 4002")
def rule_query(lake):
    ev = lake.events
    return ev.where(s.rule_query('source=Zeek severity_id>=4 hostname=host-2* class_uid < 4002 | stats count', ev.columns)).select(*COLS)


@query("broad_query_guard", "SELECT * FROM (SELECT title, title LIKE '%7%' AS broad FROM v_rules) t")
def broad_query_guard(lake):
    """Rule queries that name nothing but a source are rejected; evaluated over all rules as a column."""
    text = F.when(F.col("title").contains("7"), F.lit("source=wazuh")).otherwise(F.concat(F.lit("source=wazuh rule="), F.col("id")))
    return lake.rules.select("title", text.rlike(r"^source=\w+$").alias("broad"))


@query("entity_filter", f"SELECT {COLS_SQL} FROM v_events WHERE src_ip = '10.0.0.8' OR dst_ip = '10.0.0.8'")
def entity_filter(lake):
    return lake.events.where(s.entity_filter("ip", "10.0.0.8")).select(*COLS)


@query("is_private_ip", """SELECT flow_id, src_ip LIKE '10.%' OR src_ip LIKE '192.168.%' AS src_private, dst_ip LIKE '10.%' OR dst_ip LIKE '192.168.%' AS dst_private FROM v_flows""")
def is_private_ip(lake):
    return lake.flows.select("flow_id", net.is_private(F.col("src_ip")).alias("src_private"), net.is_private(F.col("dst_ip")).alias("dst_private"))


@query("is_internal_ip", "SELECT flow_id, src_ip LIKE '10.%' AS src_internal, dst_ip LIKE '192.168.%' AS dst_internal FROM v_flows")
def is_internal_ip(lake):
    return lake.flows.select("flow_id", net.is_internal(F.col("src_ip")).alias("src_internal"), net.is_internal(F.col("dst_ip")).alias("dst_internal"))


@query("public_ips", """SELECT id, concat_ws(',', CASE WHEN dst_ip LIKE '45.%' THEN dst_ip END, peer_ip) AS ips FROM v_artifacts""")
def public_ips(lake):
    ips = net.public_ips(F.col("hostname"), F.col("src_ip"), F.col("dst_ip"), F.col("dst_ip"), F.col("peer_ip"))
    return lake.artifacts.select("id", F.array_join(ips, ",").alias("ips"))


@query("sigma_cidr", "SELECT id, dst_ip FROM v_events WHERE CAST(split_part(dst_ip, '.', 4) AS INT) BETWEEN 16 AND 31 AND dst_ip LIKE '45.33.32.%' OR dst_ip LIKE '192.168.1.%' AND CAST(split_part(dst_ip, '.', 4) AS INT) < 8")
def sigma_cidr(lake):
    hit = net.in_networks(F.col("dst_ip"), ["45.33.32.17/28", "192.168.1.0/29", "not-a-network"])
    return lake.events.where(hit).select("id", "dst_ip")


@query("cidr_v6", "SELECT id, server_name FROM v_http WHERE server_name LIKE 'fe80:%'")
def cidr_v6(lake):
    return lake.http.where(net.in_networks(F.col("server_name"), ["fe80::/10", "2001:db8::/32"])).select("id", "server_name")


@query("search_events", f"""SELECT {COLS_SQL} FROM v_events WHERE severity_id = 4 AND time_us BETWEEN 1704067200000000 AND {NOW_US} AND lower(summary) LIKE '%click%'
 ORDER BY time_us DESC, id LIMIT 50 OFFSET 100""")
def search_events(lake):
    where = s.event_filter([("severity_id", "eq", 4)]) & s.time_range("now-30d", "now", NOW_US) & s.text_search("click", ["summary"])
    return s.search_events(lake.events, where, 50, 100).select(*COLS)


@query("event_by_id", f"SELECT {COLS_SQL} FROM v_events WHERE id = 77")
def event_by_id(lake):
    return lake.events.where(F.col("id") == 77).select(*COLS)


@query("detection_by_id", "SELECT id, severity, host, technique_id FROM v_detections WHERE id = 78")
def detection_by_id(lake):
    return lake.detections.where(F.col("id") == 78).select("id", "severity", "host", "technique_id")


@query("saved_query_run", f"SELECT {COLS_SQL} FROM v_events WHERE hostname = 'host-3' AND severity_id > 1 AND time_us BETWEEN {NOW_US} - 432000000000 AND {NOW_US} ORDER BY time_us DESC, id LIMIT 100")
def saved_query_run(lake):
    saved = {"filters": [("hostname", "eq", "host-3"), ("severity_id", "gt", 1)], "time_from": "now-5d", "time_to": "now"}
    where = s.event_filter(saved["filters"]) & s.time_range(saved["time_from"], saved["time_to"], NOW_US)
    return s.search_events(lake.events, where, 100).select(*COLS)


@query("entity_timeline", """SELECT e.id, e.time_us, e.summary, t.total FROM v_events e, (SELECT count(*) AS total FROM v_events WHERE hostname = 'host-5') t
 WHERE hostname = 'host-5' ORDER BY e.time_us DESC, e.id LIMIT 200""")
def entity_timeline(lake):
    """Newest 200 events of an entity, with the total beside each row."""
    hit = lake.events.where(s.entity_filter("host", "host-5"))
    newest = s.page(hit, [F.desc("time_us"), F.asc("id")], 200)
    return newest.select("id", "time_us", "summary", hit.agg(F.count("*")).scalar().alias("total"))


@query("terms_agg", "SELECT dst_ip AS key, count(*) AS count FROM v_events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def terms_agg(lake):
    return s.terms(lake.events, "dst_ip", 10)


@query("terms_agg_nulls", "SELECT hostname AS key, count(*) AS count FROM v_events WHERE hostname IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def terms_agg_nulls(lake):
    return s.terms(lake.events, "hostname", 20)


_HIST = " UNION ALL ".join(f"SELECT '{u}' AS unit, epoch_us(date_trunc('{u}', time)) AS bucket_us, count(*) AS count FROM v_events GROUP BY 2" for u in ("minute", "hour", "day", "week", "month"))


@query("date_histogram", _HIST)
def date_histogram(lake):
    """All five bucket sizes from one scan: minute counts first, coarser buckets from those."""
    minute = s.date_histogram(lake.events, "minute")
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(u, F.col("bucket")).alias("b")) for u in ("minute", "hour", "day", "week", "month")])
    return (minute.select("count", F.explode(units).alias("u")).groupBy("u.unit", "u.b").agg(F.sum("count").alias("count"))
            .select("unit", F.unix_micros("b").alias("bucket_us"), "count"))


@query("total_count", "SELECT count(*) AS total FROM v_events WHERE severity_id >= 2")
def total_count(lake):
    return lake.events.where(F.col("severity_id") >= 2).agg(F.count("*").alias("total"))


@query("storage_by_day", "SELECT strftime(time, '%Y-%m-%d') AS day, count(*) AS docs FROM v_events GROUP BY 1")
def storage_by_day(lake):
    return lake.events.groupBy(F.date_format("time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("docs"))


@query("protocol_histogram", """SELECT epoch_us(date_trunc('hour', time)) AS hour_us, count(*) FILTER (WHERE protocol = 'TCP') AS tcp, count(*) FILTER (WHERE protocol = 'UDP') AS udp,
 count(*) FILTER (WHERE protocol = 'ICMP') AS icmp, CAST(sum(bytes_in + bytes_out) AS BIGINT) AS total_bytes FROM v_flows GROUP BY 1""")
def protocol_histogram(lake):
    hour = lake.flows.groupBy(F.unix_micros(F.date_trunc("hour", "time")).alias("hour_us"))
    return hour.agg(*[F.count_if(F.col("protocol") == p).alias(p.lower()) for p in ("TCP", "UDP", "ICMP")], F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("total_bytes"))


@query("daily_partition", "SELECT strftime(time, '%Y.%m.%d') AS daily, strftime(time, '%Y.%m') AS monthly, count(*) AS n FROM v_events GROUP BY 1, 2")
def daily_partition(lake):
    """Partition names ``YYYY.MM.DD`` and ``YYYY.MM`` with their row counts."""
    return lake.events.groupBy(F.date_format("time", "yyyy.MM.dd").alias("daily"), F.date_format("time", "yyyy.MM").alias("monthly")).agg(F.count("*").alias("n"))


@query("monthly_partition", "SELECT strftime(time, '%Y.%m') AS monthly, count(*) AS n FROM v_detections GROUP BY 1")
def monthly_partition(lake):
    return lake.detections.groupBy(F.date_format("time", "yyyy.MM").alias("monthly")).agg(F.count("*").alias("n"))


_EXPORT = ["id", "time_us", "class_name", "severity_id", "src_ip", "dst_ip", "hostname", "username", "source", "summary"]


@query("export_events_csv", "SELECT concat_ws(',', CAST(id AS STRING), CAST(time_us AS STRING), class_name, CAST(severity_id AS STRING), src_ip, dst_ip, coalesce(hostname, ''), coalesce(username, ''), source, summary) AS line FROM v_events")
def export_events_csv(lake):
    """All events as CSV lines, NULL as ''."""
    return lake.events.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _EXPORT]).alias("line"))


_EXPORT_D = ["id", "time_us", "severity", "technique_id", "tactic", "host", "name", "status", "rule_name"]


@query("export_detections_csv", "SELECT concat_ws(',', CAST(id AS STRING), CAST(time_us AS STRING), severity, coalesce(technique_id, ''), tactic, host, name, status, coalesce(rule_name, '')) AS line FROM v_detections")
def export_detections_csv(lake):
    return lake.detections.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _EXPORT_D]).alias("line"))


@query("human_bytes", """SELECT flow_id, CASE WHEN b < 1024 THEN concat(b, '.0 B') WHEN b < 1048576 THEN concat(b // 1024, '.0 KB') WHEN b < 1073741824 THEN concat(b // 1048576, '.0 MB')
 ELSE concat(b // 1073741824, '.0 GB') END AS text FROM (SELECT flow_id, bytes_out * bytes_in AS b FROM v_flows) t""")
def human_bytes(lake):
    from wardlake.functions.text import human_bytes as hb

    return lake.flows.select("flow_id", hb(F.col("bytes_out") * F.col("bytes_in")).alias("text"))
