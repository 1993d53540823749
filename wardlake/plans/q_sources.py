"""Source parsers and normalisers over texts written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import schema
from wardlake.operators import normalizers as nz
from wardlake.plans import rawtext as raw
from wardlake.plans.registry import query
from wardlake.sources import documents as docs
from wardlake.sources import lines, readers

_FLOW = "SELECT flow_id AS uid, time_us, src_ip, src_port, dst_ip, dst_port, lower(protocol) AS proto, state AS conn_state"


def _zeek_cols(df, *extra):
    return df.select("uid", (F.col("ts") * 1_000_000).cast("long").alias("time_us"), F.col("`id.orig_h`").alias("src_ip"), F.col("`id.orig_p`").alias("src_port"), F.col("`id.resp_h`").alias("dst_ip"),
                     F.col("`id.resp_p`").alias("dst_port"), "proto", "conn_state", *extra)


@query("read_zeek_json", f"{_FLOW}, bytes_out AS orig_bytes, round(duration_ms / 1000, 4) AS duration FROM v_flows")
def read_zeek_json(lake):
    return _zeek_cols(lines.parse_zeek_json(raw.zeek_conn_json(lake.flows)), "orig_bytes", F.round("duration", 4).alias("duration"))


@query("read_zeek_tsv", f"{_FLOW} FROM v_flows")
def read_zeek_tsv(lake):
    return _zeek_cols(lines.parse_zeek_tsv(raw.zeek_conn_tsv(lake.flows), "conn"))


@query("read_zeek", f"{_FLOW}, 'conn' AS log_type, count(*) AS copies FROM v_flows, (VALUES (1), (2)) t(x) GROUP BY ALL")
def read_zeek(lake):
    """A log with both line forms: JSON first, else tab-separated."""
    both = raw.zeek_conn_json(lake.flows).unionByName(raw.zeek_conn_tsv(lake.flows))
    out = _zeek_cols(lines.parse_zeek(both, "conn"), F.col("_log_type").alias("log_type"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("copies"))


@query("norm_zeek_conn", "SELECT flow_id AS uid, time_us, src_ip, src_port, dst_ip, dst_port, CAST(4001 AS INT) AS class_uid, CASE state WHEN 'REJ' THEN 3 WHEN 'S0' THEN 2 WHEN 'RSTO' THEN 2 ELSE 1 END AS severity_id, CAST(bytes_out AS STRING) AS orig_bytes FROM v_flows")
def norm_zeek_conn(lake):
    ev = nz.zeek(lines.parse_zeek_json(raw.zeek_conn_json(lake.flows)), "conn")
    return ev.select(F.col("metadata_uid").alias("uid"), F.unix_micros("time").alias("time_us"), F.col("src_endpoint.ip").alias("src_ip"), F.col("src_endpoint.port").alias("src_port"), F.col("dst_endpoint.ip").alias("dst_ip"),
                     F.col("dst_endpoint.port").alias("dst_port"), "class_uid", "severity_id", F.col("network_traffic")["orig_bytes"].alias("orig_bytes"))


@query("norm_zeek_dns", "SELECT concat('D', id) AS uid, time_us, src_ip, query, qtype, CASE WHEN id % 3 = 0 THEN '' ELSE concat('1.1.1.1,2.2.2.', id % 200) END AS answers FROM v_dns")
def norm_zeek_dns(lake):
    ev = nz.zeek(lines.parse_zeek_tsv(raw.zeek_dns_tsv(lake.dns), "dns"), "dns")
    t = F.col("network_traffic")
    return ev.where("class_uid = 4003").select(F.col("metadata_uid").alias("uid"), F.unix_micros("time").alias("time_us"), F.col("src_endpoint.ip").alias("src_ip"), t["query"].alias("query"), t["qtype"].alias("qtype"), t["answers"].alias("answers"))


@query("norm_zeek_http", "SELECT concat('H', id) AS uid, host, uri, user_agent, method, CAST(content_length AS STRING) AS body_len FROM v_http")
def norm_zeek_http(lake):
    ev = nz.zeek(lines.parse_zeek_json(raw.zeek_http_json(lake.http)), "http")
    t = F.col("network_traffic")
    return ev.where("class_uid = 4002").select(F.col("metadata_uid").alias("uid"), F.col("dst_endpoint.hostname").alias("host"), t["uri"].alias("uri"), t["user_agent"].alias("user_agent"), t["method"].alias("method"), t["response_body_len"].alias("body_len"))


@query("norm_zeek_ssl", "SELECT concat('S', id) AS uid, server_name, 'TLSv13' AS version, md5(url) AS ja3 FROM v_http")
def norm_zeek_ssl(lake):
    ev = nz.zeek(lines.parse_zeek_json(raw.zeek_ssl_json(lake.http)), "ssl")
    t = F.col("network_traffic")
    return ev.where("class_uid = 4001").select(F.col("metadata_uid").alias("uid"), F.col("dst_endpoint.hostname").alias("server_name"), t["version"].alias("version"), t["ja3"].alias("ja3"))


@query("read_syslog", """SELECT id, CAST(k % 24 AS INT) AS facility, severity_id AS severity, CASE severity_id WHEN 1 THEN 'alert' WHEN 2 THEN 'critical' WHEN 3 THEN 'error' WHEN 4 THEN 'warning' ELSE 'notice' END AS severity_name,
 CASE WHEN id % 3 = 2 THEN NULL WHEN id % 3 = 1 THEN coalesce(hostname, '-') ELSE hostname END AS hostname, CASE id % 3 WHEN 0 THEN concat('app-', k) WHEN 1 THEN 'sshd' END AS app_name,
 CASE WHEN id % 3 < 2 THEN CAST(id AS STRING) END AS process_id, CASE WHEN id % 3 = 2 THEN concat('-- ', summary) ELSE summary END AS message FROM v_events""")
def read_syslog(lake):
    return lines.parse_syslog(raw.syslog(lake.events)).select("id", "facility", "severity", "severity_name", "hostname", "app_name", "process_id", "message")


@query("read_authlog", """SELECT id, concat('user-', user_id) AS user, CASE WHEN id % 12 < 5 OR id % 12 = 9 THEN src_ip END AS source_ip, CASE WHEN id % 12 < 4 THEN 1024 + k END AS source_port,
 CASE id % 12 WHEN 0 THEN 'password' WHEN 1 THEN 'publickey' WHEN 2 THEN 'password' WHEN 3 THEN 'publickey' WHEN 4 THEN 'unknown' WHEN 5 THEN 'session' WHEN 6 THEN 'session' WHEN 7 THEN 'sudo' WHEN 8 THEN 'su' ELSE 'pam' END AS auth_method,
 CASE WHEN id % 12 IN (2, 3, 4, 9) THEN 'Failure' ELSE 'Success' END AS status, CASE WHEN id % 12 = 6 THEN 'Logoff' ELSE 'Logon' END AS outcome,
 CASE id % 12 WHEN 5 THEN 'login' WHEN 6 THEN 'CRON' WHEN 7 THEN 'sudo' WHEN 8 THEN 'su' ELSE 'sshd' END AS service FROM v_events WHERE id % 12 < 10""")
def read_authlog(lake):
    """Two lines of twelve are of no known form and must be skipped."""
    return lines.parse_authlog(raw.authlog(lake.events)).drop("value")


_DOC_SQL = "SELECT CAST(id AS STRING) AS id, time_us FROM v_events WHERE k <> 99 AND time_us > 1705000000000000"


@query("read_wazuh", _DOC_SQL)
def read_wazuh(lake):
    """Exported alerts newer than the checkpoint; broken times sort after it and are left to the normaliser."""
    df = docs.since(docs.parse_documents(raw.wazuh(lake.events), "wazuh"), "wazuh", "2024-01-11T19:06:40")
    return df.where(nz.iso_time(F.col("timestamp")).isNotNull()).select("id", F.unix_micros(nz.iso_time(F.col("timestamp"))).alias("time_us"))


@query("read_prowler", "SELECT CAST(id AS STRING) AS id, time_us FROM v_events WHERE time_us > 1705000000000000")
def read_prowler(lake):
    df = docs.since(docs.parse_documents(raw.prowler(lake.events), "prowler"), "prowler", "2024-01-11T19:06:40")
    return df.select("id", F.unix_micros(nz.iso_time(F.col("inserted_at"))).alias("time_us"))


@query("read_velociraptor", "SELECT concat('F.', id) AS flow_id, CASE k % 4 WHEN 0 THEN 'Windows.EventLogs.Evtx' WHEN 1 THEN 'Linux.Sys.Pslist' WHEN 2 THEN 'Generic.Network.Netstat' ELSE 'Server.Flows' END AS artifact FROM v_events")
def read_velociraptor(lake):
    return docs.parse_documents(raw.velociraptor(lake.events), "velociraptor").select("flow_id", F.col("_artifact_name").alias("artifact"))


@query("read_suricata", "SELECT CASE WHEN k % 4 < 2 THEN 'alert' WHEN k % 4 = 2 THEN 'dns' ELSE 'http' END AS event_type, count(*) AS n FROM v_events GROUP BY 1")
def read_suricata(lake):
    return docs.parse_documents(raw.suricata(lake.events), "suricata").groupBy("event_type").agg(F.count("*").alias("n"))


_WCLS = "CASE k % 5 WHEN 0 THEN 1007 WHEN 1 THEN 4001 WHEN 2 THEN 3002 WHEN 3 THEN 1001 ELSE 2001 END"
_LVL = "CASE WHEN k % 17 = 16 THEN 5 ELSE k % 16 END"


@query("norm_wazuh", f"""SELECT CAST(id AS STRING) AS uid, CAST({_WCLS} AS INT) AS class_uid, CASE WHEN {_LVL} >= 14 THEN 5 WHEN {_LVL} >= 11 THEN 4 WHEN {_LVL} >= 7 THEN 3 WHEN {_LVL} >= 4 THEN 2 ELSE 1 END AS severity_id,
 CASE WHEN k <> 99 THEN time_us END AS time_us, src_ip, CASE WHEN k % 4 = 0 THEN '10.8.8.8' ELSE dst_ip END AS dst_ip, hostname AS host, CASE WHEN k % 3 = 0 THEN coalesce(username, 'svc') ELSE 'svc' END AS username,
 cmd_line, process_name, CAST(id AS INT) AS pid, process_hash AS sha, summary AS title FROM v_events""")
def norm_wazuh(lake):
    ev = nz.wazuh(docs.parse_documents(raw.wazuh(lake.events), "wazuh"))
    return ev.select(F.col("metadata_uid").alias("uid"), "class_uid", "severity_id", F.unix_micros("time").alias("time_us"), F.col("src_endpoint.ip").alias("src_ip"), F.col("dst_endpoint.ip").alias("dst_ip"), F.col("dst_endpoint.hostname").alias("host"),
                     F.col("actor_user.name").alias("username"), F.col("process.cmd_line").alias("cmd_line"), F.col("process.name").alias("process_name"), F.col("process.pid").alias("pid"), F.col("process.hash_sha256").alias("sha"), F.col("finding_info.title").alias("title"))


@query("norm_wazuh_attacks", """SELECT CAST(id AS STRING) AS uid, pos, technique, CASE WHEN k % 2 = 0 THEN (CASE pos WHEN 0 THEN 'Credential Access' ELSE 'Execution' END) ELSE 'Lateral Movement' END AS tactic,
 CASE WHEN k % 2 = 0 THEN (CASE pos WHEN 0 THEN 'TA0006' ELSE 'TA0002' END) ELSE 'TA0008' END AS tactic_id, CASE pos WHEN 0 THEN 'LSASS Memory' ELSE 'T1059' END AS name, CASE pos WHEN 0 THEN '001' END AS sub
 FROM v_events, (VALUES (0, 'T1003.001'), (1, 'T1059')) t(pos, technique)""")
def norm_wazuh_attacks(lake):
    ev = nz.wazuh(docs.parse_documents(raw.wazuh(lake.events), "wazuh"))
    a = ev.select(F.col("metadata_uid").alias("uid"), F.posexplode("finding_info.attacks").alias("pos", "a"))
    return a.select("uid", "pos", F.col("a.technique.uid").alias("technique"), F.col("a.tactic.name").alias("tactic"), F.col("a.tactic.uid").alias("tactic_id"), F.col("a.technique.name").alias("name"), F.col("a.technique.sub_technique").alias("sub"))


def _suricata(lake):
    return nz.suricata(docs.parse_documents(raw.suricata(lake.events), "suricata"))


@query("norm_suricata_alert", """SELECT CAST(id AS STRING) AS uid, time_us, CASE k % 6 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 3 END AS severity_id, summary AS title, CAST(k + 2000 AS STRING) AS signature_id,
 CASE WHEN k % 2 = 0 THEN 'T1071.001=Application Layer Protocol: Web Protocols/001/Command and Control;T9999=T9999//' ELSE 'T1110=Brute Force//Credential Access' END AS attacks FROM v_events WHERE k % 4 < 2""")
def norm_suricata_alert(lake):
    text = F.array_join(F.transform("finding_info.attacks", lambda a: F.concat(a["technique"]["uid"], F.lit("="), a["technique"]["name"], F.lit("/"), F.coalesce(a["technique"]["sub_technique"], F.lit("")), F.lit("/"), F.coalesce(a["tactic"]["name"], F.lit("")))), ";")
    ev = _suricata(lake).where("class_uid = 2001")
    return ev.select(F.col("metadata_uid").alias("uid"), F.unix_micros("time").alias("time_us"), "severity_id", F.col("finding_info.title").alias("title"), F.col("finding_info.analytic.uid").alias("signature_id"), text.alias("attacks"))


@query("norm_suricata_dns", "SELECT CAST(id AS STRING) AS uid, concat('q', k, '.example.com') AS query, '1.2.3.4' AS answers, src_ip FROM v_events WHERE k % 4 = 2")
def norm_suricata_dns(lake):
    t = F.col("network_traffic")
    return _suricata(lake).where("class_uid = 4003").select(F.col("metadata_uid").alias("uid"), t["query"].alias("query"), t["answers"].alias("answers"), F.col("src_endpoint.ip").alias("src_ip"))


@query("norm_suricata_net", "SELECT CAST(id AS STRING) AS uid, 'http' AS event_type, summary AS url, dst_port FROM v_events WHERE k % 4 = 3")
def norm_suricata_net(lake):
    t = F.col("network_traffic")
    return _suricata(lake).where("class_uid = 4001").select(F.col("metadata_uid").alias("uid"), t["event_type"].alias("event_type"), t["url"].alias("url"), F.col("dst_endpoint.port").alias("dst_port"))


_PT = dict(zip(raw.PROWLER_CHECKS, ["T1078.004", "T1078.004", "T1078", "T1530", "T1530", "T1562.008", "T1562", None, "T1562", "T1190"]))


@query("norm_prowler", "SELECT CAST(id AS STRING) AS uid, CASE k % 6 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 4 END AS severity_id, CASE k % 10 " + " ".join(f"WHEN {i} THEN {chr(39) + _PT[c] + chr(39) if _PT[c] else 'NULL'}" for i, c in enumerate(raw.PROWLER_CHECKS))
       + " END AS technique, CASE WHEN k % 3 <> 0 THEN summary ELSE CASE k % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(raw.PROWLER_CHECKS)) + " END END AS title, 'aws' AS host, 'svc' AS service FROM v_events")
def norm_prowler(lake):
    ev = nz.prowler(docs.parse_documents(raw.prowler(lake.events), "prowler"))
    return ev.select(F.col("metadata_uid").alias("uid"), "severity_id", F.get("finding_info.attacks", F.lit(0))["technique"]["uid"].alias("technique"), F.col("finding_info.title").alias("title"), F.col("src_endpoint.hostname").alias("host"), F.col("unmapped")["service"].alias("service"))


@query("norm_velociraptor", """SELECT concat('F.', id) AS uid, CASE WHEN k % 4 IN (1, 2) THEN 1007 ELSE 2001 END AS class_uid, CASE WHEN k % 4 <> 0 THEN 1 ELSE CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 1 END END AS severity_id,
 CASE WHEN k % 4 = 3 THEN time_us // 1000000 * 1000000 ELSE time_us END AS time_us, CASE WHEN k % 4 <> 3 THEN CAST(id AS INT) END AS pid, CASE WHEN k % 4 <> 3 THEN process_name END AS process_name, CASE WHEN k % 4 <> 3 THEN username END AS username,
 CASE k % 4 WHEN 0 THEN CASE id % 5 WHEN 0 THEN 'Windows EventID 4624: Valid Accounts' WHEN 1 THEN 'Windows EventID 4625: Brute Force' WHEN 2 THEN 'Windows EventID 4688: Command and Scripting Interpreter' WHEN 3 THEN 'Windows EventID 7045: Windows Service' ELSE 'Windows EventID 1102: Windows.EventLogs.Evtx' END
  WHEN 1 THEN 'Velociraptor artifact: Linux.Sys.Pslist' WHEN 2 THEN 'Velociraptor artifact: Generic.Network.Netstat' ELSE concat('Velociraptor flow F.', id, ': A, B') END AS title,
 CASE k % 4 WHEN 0 THEN CASE id % 5 WHEN 0 THEN 'T1078' WHEN 1 THEN 'T1110' WHEN 2 THEN 'T1059' WHEN 3 THEN 'T1543.003' END WHEN 1 THEN 'T1057' WHEN 2 THEN 'T1049' END AS technique FROM v_events""")
def norm_velociraptor(lake):
    ev = nz.velociraptor(docs.parse_documents(raw.velociraptor(lake.events), "velociraptor"))
    return ev.select(F.col("metadata_uid").alias("uid"), "class_uid", "severity_id", F.unix_micros("time").alias("time_us"), F.col("process.pid").alias("pid"), F.col("process.name").alias("process_name"), F.col("actor_user.name").alias("username"),
                     F.col("finding_info.title").alias("title"), F.get("finding_info.attacks", F.lit(0))["technique"]["uid"].alias("technique"))


@query("dead_letter", "SELECT CAST(id AS STRING) AS uid, 'Wazuh' AS source, 'schema_validation' AS error_type FROM v_events WHERE k = 99")
def dead_letter(lake):
    _, dead = nz.split_valid(nz.wazuh(docs.parse_documents(raw.wazuh(lake.events), "wazuh")))
    return dead.select(F.get_json_object("raw", "$.metadata_uid").alias("uid"), "source", "error_type")


@query("apply_field_mapping", "SELECT CAST(id AS STRING) AS uid, concat('', CAST(k * 10 AS STRING)) AS product, coalesce(hostname, 'Windows') AS os_name, summary AS note FROM v_events")
def apply_field_mapping(lake):
    """Overrides from a YAML text; a missing raw value keeps what the normaliser set."""
    ev = nz.wazuh(docs.parse_documents(raw.wazuh(lake.events), "wazuh"))
    out = nz.apply_field_mapping(ev, "field_mappings:\n  metadata_product: rule.id\n  dst_endpoint.os_name: agent.name\n  unmapped.note: rule.description\n  no_such.path: rule.id\n")
    return out.select(F.col("metadata_uid").alias("uid"), F.col("metadata_product").alias("product"), F.col("dst_endpoint.os_name").alias("os_name"), F.col("unmapped")["note"].alias("note"))


@query("flatten_event", "SELECT CAST(id AS STRING) AS event_uid, CASE WHEN k <> 99 THEN time_us END AS time_us, src_ip, hostname, 'Wazuh' AS source, summary, process_hash FROM v_events")
def flatten_event(lake):
    flat = schema.flatten(nz.wazuh(docs.parse_documents(raw.wazuh(lake.events), "wazuh")))
    return flat.select("event_uid", F.unix_micros("time").alias("time_us"), "src_ip", "hostname", "source", "summary", "process_hash")


@query("ocsf_to_flow", "SELECT flow_id, src_ip, dst_ip, src_port, dst_port, protocol, bytes_in, bytes_out, duration_ms, time_us FROM v_flows")
def ocsf_to_flow(lake):
    return schema.to_flow(nz.zeek(lines.parse_zeek_json(raw.zeek_conn_json(lake.flows)), "conn"))


@query("read_webhook", "SELECT id, CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END AS accepted, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS rejected, concat('{\"id\":', id, ',\"summary\":\"', summary, '\"}') AS first_event FROM v_events WHERE id % 3 < 2")
def read_webhook(lake):
    rows = docs.parse_webhook(raw.webhook(lake.events), "probe", "2024-01-31T00:00:00Z")
    return rows.groupBy("id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.min(F.when(F.col("accepted"), F.col("event"))).alias("first_event"))


@query("read_stix", """SELECT ioc_type, value, c AS confidence, CASE WHEN c >= 76 THEN 'critical' WHEN c >= 51 THEN 'high' WHEN c >= 26 THEN 'medium' ELSE 'low' END AS severity, concat('Indicator ', id) AS description FROM (
 SELECT id, ioc_type, value, greatest(0, least(100, confidence * 2 - 50)) AS c FROM v_iocs UNION ALL SELECT id, 'url', concat('http://', value, '/x'), greatest(0, least(100, confidence * 2 - 50)) FROM v_iocs WHERE ioc_type = 'ip') t""")
def read_stix(lake):
    return docs.parse_stix(raw.stix(lake.iocs), "feed").select("ioc_type", "value", "confidence", "severity", "description")


@query("read_bus", "SELECT id, summary, severity_id FROM v_events")
def read_bus(lake):
    """Messages as a bus carries them (binary JSON), read back with their schema."""
    messages = readers.to_bus(lake.events.select("id", "summary", "severity_id")).select(F.encode("value", "utf-8").alias("value"))
    return readers.from_bus(messages, "id long, summary string, severity_id int")


@query("publish_bus", "SELECT CAST(id AS STRING) AS key, concat('{\"id\":', id, ',\"source\":\"', source, '\"}') AS value FROM v_events")
def publish_bus(lake):
    return readers.to_bus(lake.events.select("id", "source"), "id")


@query("read_agent_events", "SELECT CAST(id AS STRING) AS uid, class_uid, src_ip, username FROM v_events")
def read_agent_events(lake):
    """Batches that already carry the event schema."""
    e = lake.events
    ev = schema.event(e, class_uid=F.col("class_uid"), metadata_uid=F.col("id").cast("string"), src_endpoint=schema.endpoint(ip=F.col("src_ip")), actor_user=schema.user(name=F.col("username")), time=F.col("time"))
    text = ev.select(F.to_json(F.struct(*schema.EVENT)).alias("value"))
    back = readers.from_bus(text, ", ".join(f"`{n}` {t}" for n, t in schema.EVENT.items()))
    return back.select(F.col("metadata_uid").alias("uid"), "class_uid", F.col("src_endpoint.ip").alias("src_ip"), F.col("actor_user.name").alias("username"))
