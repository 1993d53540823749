"""Endpoint tagging and severities, web/TLS/DNS/payload predicates, string helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import domains, endpoint, protocols, tagging, text
from wardlake.plans.registry import query


def _tag_sql(table, select):
    arms = ", ".join(f"CASE WHEN {cond} THEN {ids.split()} END" for ids, cond in table)
    return f"SELECT id, coalesce(array_to_string(list_sort(list_distinct(flatten(list_filter([{arms}], lambda x: x IS NOT NULL)))), ','), '') AS tags FROM (SELECT {select} FROM v_endpoint) e"


def _tagged(fn):
    return lambda lake: fn(lake.endpoint).select("id", F.array_join("technique_ids", ",").alias("tags"))


query("tag_process", _tag_sql(tagging.PROCESS, "id, lower(name) AS n, lower(cmd_line) AS c, lower(coalesce(exe_path, '')) AS p, uid, ppid"))(_tagged(tagging.with_process_tags))
query("tag_file", _tag_sql(tagging.FILE, "id, path, action"))(_tagged(tagging.with_file_tags))
query("tag_network", _tag_sql(tagging.NETWORK, "id, remote_port, state"))(_tagged(tagging.with_network_tags))
query("tag_auth", _tag_sql(tagging.AUTH, "id, auth_method, status, outcome, source_ip"))(_tagged(tagging.with_auth_tags))
query("tag_registry", _tag_sql(tagging.REGISTRY, "id, lower(reg_key) AS key"))(_tagged(tagging.with_registry_tags))


@query("severity_file", "SELECT id, CASE WHEN regexp_matches(path, '^(/etc/passwd|/etc/shadow|/etc/sudoers|/etc/ssh/|/usr/bin/|/usr/sbin/)') THEN 'high' ELSE 'low' END AS severity FROM v_endpoint")
def severity_file(lake):
    return lake.endpoint.select("id", endpoint.severity_file(F.col("path")).alias("severity"))


@query("severity_conn", "SELECT id, CASE WHEN remote_port IN (4444,5555,6666,8888,1337,31337) THEN 'high' WHEN state = 'ESTABLISHED' AND remote_port > 10000 THEN 'medium' ELSE 'informational' END AS severity FROM v_endpoint")
def severity_conn(lake):
    return lake.endpoint.select("id", endpoint.severity_conn(F.col("remote_port"), F.col("state")).alias("severity"))


@query("severity_registry", "SELECT id, CASE WHEN regexp_matches(lower(reg_key), 'currentversion/run|image file execution options|control/lsa|knowndlls') THEN 'high' ELSE 'medium' END AS severity FROM v_endpoint")
def severity_registry(lake):
    return lake.endpoint.select("id", endpoint.severity_registry(F.col("reg_key")).alias("severity"))


@query("exclude_names", "SELECT id, path FROM v_endpoint WHERE NOT (path LIKE '%.log' OR path = '/tmp/tool')")
def exclude_names(lake):
    return lake.endpoint.where(~endpoint.excluded(F.col("path"), ["*.log", "/tmp/tool"])).select("id", "path")


@query("norm_syslog_auth", "SELECT id, CASE WHEN status = 'Failure' THEN 'medium' WHEN auth_method IN ('sudo','su') THEN 'low' ELSE 'informational' END AS severity, outcome AS activity, CASE WHEN outcome = 'Logoff' THEN 2 ELSE 1 END AS activity_id FROM v_endpoint")
def norm_syslog_auth(lake):
    act = endpoint.auth_activity(F.col("outcome"))
    return lake.endpoint.select("id", endpoint.severity_auth(F.col("status"), F.col("auth_method")).alias("severity"), act["name"].alias("activity"), act["id"].alias("activity_id"))


# ------------------------------------------------------------------------------------- web and TLS


@query("http_suspicious_request", """SELECT id, coalesce(regexp_matches(uri, '[.][.]/|;|\\||`|%00'), false) OR regexp_matches(upper(uri), '('' OR |UNION( |[+]|%20)SELECT|DROP( |[+]|%20)TABLE|[.]PHP[?]CMD=|PASSTHRU|SYSTEM[(])')
 OR coalesce(user_agent = '' OR regexp_matches(lower(user_agent), 'sqlmap|nikto|dirbuster|nmap|masscan'), false) OR (user_agent IS NULL AND method = 'POST') OR contains(uri, '/fr/9') AS suspicious FROM v_http""")
def http_suspicious_request(lake):
    return lake.http.select("id", protocols.http_suspicious_request(F.col("uri"), F.col("user_agent"), F.col("method"), ["/fr/9"]).alias("suspicious"))


@query("http_suspicious_response", """SELECT id, coalesce(content_length > 10000000 AND NOT regexp_matches(content_type, 'video|audio|image|zip|octet-stream'), false) OR coalesce(regexp_matches(lower(server), 'apache/1[.]|iis/[56][.]'), false) AS suspicious FROM v_http""")
def http_suspicious_response(lake):
    return lake.http.select("id", protocols.http_suspicious_response(F.col("content_length"), F.col("content_type"), F.col("server")).alias("suspicious"))


@query("tls_suspicious_sni", "SELECT id, server_name = '' OR strlen(server_name) > 253 OR contains(server_name, ':') OR regexp_full_match(server_name, '([0-9]{1,3}[.]){3}[0-9]{1,3}') OR server_name = 'example.com' OR server_name LIKE '%.example.net' AS suspicious FROM v_http")
def tls_suspicious_sni(lake):
    return lake.http.select("id", protocols.tls_suspicious_sni(F.col("server_name"), ["example.com.invalid", "example.net"]).alias("suspicious"))


@query("ssh_suspicious", "SELECT flow_id, src_port % 5 = 0 OR src_port % 7 = 0 OR src_port % 3 = 1 AS suspicious FROM v_flows")
def ssh_suspicious(lake):
    """Banners derived from flows: SSH-1, an empty version, or a listed library."""
    p = F.col("src_port")
    version = F.when(p % 5 == 0, "1.99").otherwise("2.0")
    software = F.when(p % 7 == 0, "").when(p % 3 == 1, F.concat(F.lit("Paramiko_"), p)).otherwise("OpenSSH_9.6")
    return lake.flows.select("flow_id", protocols.ssh_suspicious(version, software, ["PARAMIKO", "impacket"]).alias("suspicious"))


@query("rdp_suspicious", "SELECT flow_id, p = 0 OR ((p & 1) <> 0 AND (p & 10) = 0) AS suspicious FROM (SELECT flow_id, src_port % 16 AS p FROM v_flows) t")
def rdp_suspicious(lake):
    return lake.flows.select("flow_id", protocols.rdp_suspicious((F.col("src_port") % 16).cast("int")).alias("suspicious"))


@query("smb_suspicious", "SELECT flow_id, v = 0 OR (s = 0 AND coalesce(c, -1) <> 0) OR (u AND coalesce(c IN (5, 9, 11, 17), false)) AS suspicious FROM (SELECT flow_id, src_port % 6 AS v, src_port % 4 AS s, CASE WHEN src_port % 19 = 18 THEN NULL ELSE src_port % 19 END AS c, src_port % 2 = 0 AS u FROM v_flows) t")
def smb_suspicious(lake):
    p = F.col("src_port")
    bad = protocols.smb_suspicious(F.when(p % 6 == 0, "SMB1").otherwise("SMB2"), p % 4, F.when(p % 19 != 18, p % 19), p % 2 == 0)
    return lake.flows.select("flow_id", bad.alias("suspicious"))


_HEXES = ["GET /a HTTP/1.1", "SSH-2.0-OpenSSH_9", "EHLO mail.example", "USER anonymous", "hello there", "HTTP/1.1 200 OK"]
_PICK = "CASE k % 8 " + " ".join(f"WHEN {i} THEN '{t.encode().hex().upper()}'" for i, t in enumerate(_HEXES)) + " WHEN 6 THEN '1603010200010001FC0303AA' ELSE 'ABCD01000001000000000000' END"
_OBS = "CASE k % 8 WHEN 0 THEN 'http' WHEN 1 THEN 'ssh' WHEN 2 THEN 'smtp' WHEN 3 THEN 'ftp' WHEN 4 THEN NULL WHEN 5 THEN 'http' WHEN 6 THEN 'tls' ELSE 'dns' END"
_PORTS = "CASE id % 9 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 25 WHEN 4 THEN 21 WHEN 5 THEN 53 WHEN 6 THEN 8443 WHEN 7 THEN 9999 ELSE 8080 END"


@query("proto_anomaly", f"""SELECT id, port, observed, CASE WHEN observed IS NOT NULL THEN 'high' ELSE 'medium' END AS severity FROM (SELECT id, {_PORTS} AS port, {_OBS} AS observed,
 CASE id % 9 WHEN 0 THEN 'http' WHEN 1 THEN 'tls' WHEN 2 THEN 'ssh' WHEN 3 THEN 'smtp' WHEN 4 THEN 'ftp' WHEN 5 THEN 'dns' WHEN 6 THEN 'tls' WHEN 7 THEN NULL ELSE 'http' END AS expected FROM v_events) t
 WHERE expected IS NOT NULL AND (observed <> expected OR observed IS NULL AND port IN (22, 53, 443))""")
def proto_anomaly(lake):
    rows = lake.events.select("id", F.expr(_PORTS).alias("port"), F.unhex(F.expr(_PICK)).alias("payload"))
    rows = rows.withColumn("observed", protocols.observed_protocol(F.col("payload"))).withColumn("severity", protocols.proto_anomaly(F.col("port"), F.col("observed")))
    return rows.where("severity IS NOT NULL").select("id", "port", "observed", "severity")


# ------------------------------------------------------------------------------------- names

_ENT = "CASE WHEN {x} = '' THEN 0.0 ELSE list_aggregate(string_split({x}, ''), 'entropy') END"


@query("shannon_entropy", f"SELECT id, round({_ENT.format(x='query')}, 6) AS whole, round({_ENT.format(x=chr(39).join(['split_part(query, ', '.', ', 1)']))}, 6) AS first_label FROM v_dns")
def shannon_entropy(lake):
    q = F.col("query")
    return lake.dns.select("id", F.round(text.shannon_entropy(q), 6).alias("whole"), F.round(text.shannon_entropy(text.first_label(q)), 6).alias("first_label"))


@query("entropy_messages", "SELECT doc_id, round(list_aggregate(string_split(text, ''), 'entropy'), 6) AS bits FROM documents")
def entropy_messages(lake):
    """Entropy of whole message texts by counting characters as rows: memory does not grow with the alphabet or the text."""
    chars = lake.table("documents").select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    per = chars.groupBy("doc_id", "c").agg(F.count("*").alias("k"))
    tot = per.groupBy("doc_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2(F.col("k").cast("double"))).alias("s"))
    return tot.select("doc_id", F.round(F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n"), 6).alias("bits"))


_WL = "|".join(fixed.DGA_WHITELIST)
_BG = "[" + ", ".join(f"'{b}'" for b in fixed.COMMON_BIGRAMS) + "]"


@query("dga_score", f"""WITH a AS (SELECT id, query, string_split(query, '.') AS l FROM v_dns WHERE NOT regexp_matches(query, '{_WL}')), b AS (SELECT id, query, CASE WHEN len(l) >= 2 THEN l[len(l) - 1] ELSE l[1] END AS s FROM a),
 c AS (SELECT *, length(s) AS n, length(regexp_replace(s, '[^0-9]', '', 'g')) AS d, length(regexp_replace(s, '[^a-z]', '', 'g')) AS al, length(regexp_replace(s, '[^aeiou]', '', 'g')) AS v,
  list_max(list_transform(regexp_extract_all(s, '[bcdfghjklmnpqrstvwxyz]+'), lambda x: length(x))) AS r, list_filter(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)), lambda p: regexp_full_match(p, '[a-z]{{2}}')) AS pr FROM b WHERE length(s) >= 6),
 e AS (SELECT *, len(list_filter(pr, lambda p: list_contains({_BG}, p))) AS cb FROM c),
 f AS (SELECT id, query, s AS sld, round(least(1.0, CAST((CASE WHEN n <= 9 THEN 0 WHEN n <= 15 THEN 0.05 WHEN n <= 20 THEN 0.15 WHEN n <= 30 THEN 0.25 ELSE 0.35 END) + (CASE WHEN d / n > 0.5 THEN 0.25 WHEN d / n > 0.3 THEN 0.15 WHEN d / n > 0.1 THEN 0.05 ELSE 0 END)
  + (CASE WHEN al = 0 THEN 0.25 WHEN v / al < 0.1 THEN 0.25 WHEN v / al < 0.2 THEN 0.15 WHEN v / al < 0.3 THEN 0.05 ELSE 0 END) + (CASE WHEN r > 6 THEN 0.2 WHEN r > 4 THEN 0.1 ELSE 0 END)
  + (CASE WHEN n > 8 AND regexp_full_match(s, '[0-9a-f]+') THEN 0.4 WHEN n > 10 AND regexp_full_match(s, '[a-z2-7]+') AND regexp_matches(s, '[2-7]') THEN 0.3 ELSE 0 END)
  + (CASE WHEN len(pr) = 0 THEN 0.2 WHEN cb / len(pr) < 0.1 THEN 0.2 WHEN cb / len(pr) < 0.2 THEN 0.1 ELSE 0 END) AS DOUBLE)), 2) AS score FROM e)
 SELECT id, sld, score, CASE WHEN score >= 0.7 THEN 'high' ELSE 'medium' END AS severity FROM f WHERE score >= 0.5""")
def dga_score(lake):
    return domains.dga(lake.dns, "query").select("id", "sld", "score", "severity")


@query("dns_tunnel", f"""WITH a AS (SELECT *, string_split(query, '.') AS l FROM v_dns), b AS (SELECT *, CASE WHEN strlen(query) > 100 THEN 'name_length' WHEN len(list_filter(l, lambda x: strlen(x) > 40)) > 0 THEN 'label_length'
  WHEN strlen(l[1]) > 10 AND list_aggregate(string_split(l[1], ''), 'entropy') > 3.2 THEN 'label_entropy' WHEN len(l) > 3 AND strlen(array_to_string(l[1:len(l) - 2], '')) > 20 AND list_aggregate(string_split(array_to_string(l[1:len(l) - 2], ''), ''), 'entropy') > 3.2 THEN 'combined_entropy'
  WHEN len(l) > 10 THEN 'depth' END AS early, array_to_string(l[greatest(1, len(l) - 1):], '.') AS base FROM a),
 c AS (SELECT *, count(*) FILTER (WHERE early IS NULL) OVER (PARTITION BY base ORDER BY time_us, id) AS n FROM b), d AS (SELECT id, coalesce(early, CASE WHEN n % 101 = 0 THEN 'volume' WHEN qtype = 'TXT' THEN 'txt_query' WHEN qtype = 'NULL' THEN 'null_query' WHEN qtype = 'ANY' THEN 'any_query' END) AS reason FROM c)
 SELECT id, reason, CASE WHEN reason IN ('name_length', 'label_length', 'label_entropy') THEN 'high' WHEN reason IN ('txt_query', 'any_query') THEN 'low' ELSE 'medium' END AS severity FROM d WHERE reason IS NOT NULL""")
def dns_tunnel(lake):
    return domains.dns_tunnel(lake.dns, "query", "qtype", "time_us", "id", entropy=3.2).select("id", "reason", "severity")


@query("exe_name", "SELECT id, string_split(path, '/')[-1] AS exe FROM v_endpoint")
def exe_name(lake):
    return lake.endpoint.select("id", text.exe_name(F.translate("path", "/", "\\")).alias("exe"))


@query("parse_sha256", "SELECT id, CASE WHEN id % 4 <> 1 THEN process_hash END AS sha FROM v_events")
def parse_sha256(lake):
    h = F.col("process_hash")
    packed = F.when(F.col("id") % 4 == 0, F.concat(F.lit("SHA1=ab,MD5=cd, sha256="), h, F.lit(",IMPHASH=ef"))).when(F.col("id") % 4 == 1, F.concat(F.lit("MD5="), h)).otherwise(F.concat(F.lit("SHA256="), h))
    return lake.events.select("id", text.sha256_of(packed).alias("sha"))


@query("hex_or_int", "SELECT id, CASE id % 3 WHEN 2 THEN NULL ELSE user_id END AS number FROM v_events")
def hex_or_int(lake):
    u = F.col("user_id")
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("0x"), F.hex(u))).when(F.col("id") % 3 == 1, u.cast("string")).otherwise(F.lit("n/a"))
    return lake.events.select("id", text.hex_or_int(raw).alias("number"))


@query("technique_split", "SELECT id, split_part(technique_id, '.', 1) AS parent, CASE WHEN contains(technique_id, '.') THEN split_part(technique_id, '.', 2) END AS sub FROM v_detections WHERE technique_id IS NOT NULL")
def technique_split(lake):
    parts = F.split("technique_id", r"\.", 2)
    return lake.detections.where("technique_id IS NOT NULL").select("id", F.get(parts, F.lit(0)).alias("parent"), F.get(parts, F.lit(1)).alias("sub"))
