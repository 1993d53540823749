"""Rule matching over events: every modifier, conditions, candidates, detection and backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake.operators import alerts as al
from wardlake.operators import ruleindex
from wardlake.operators import rules as r
from wardlake.plans.registry import query
from wardlake.plans.rulepack import BUNDLED

RULES = r.load_rules(BUNDLED)


def _sel(selection, condition="s"):
    """Events matching one selection."""

    def run(lake):
        ev = lake.events
        doc = {"id": "x", "detection": {"s": selection, "condition": condition}}
        return ev.where(r.compile_rule(r.rule_from_dict(doc), ev.columns)).select("id", "summary")

    return run


def _ev(where):
    return f"SELECT id, summary FROM v_events WHERE {where}"


query("sigma_exact", _ev("lower(hostname) IN ('host-1', 'host-2') AND CAST(severity_id AS VARCHAR) = '3'"))(_sel({"hostname": ["HOST-1", "host-2", "host-*"], "severity_id": 3}))
query("sigma_contains", _ev("contains(lower(cmd_line), 'whoami') OR contains(lower(cmd_line), 'lsass')"))(_sel({"cmd_line|contains": ["WhoAmI", "lsass"]}))
query("sigma_startswith", _ev("starts_with(lower(cmd_line), 'powershell') OR starts_with(lower(cmd_line), 'bash')"))(_sel({"cmd_line|startswith": ["PowerShell", "bash"]}))
query("sigma_endswith", _ev("ends_with(lower(cmd_line), '-d') OR ends_with(lower(cmd_line), '.exe')"))(_sel({"cmd_line|endswith": ["-D", ".EXE"]}))
query("sigma_all", _ev("contains(lower(cmd_line), 'powershell') AND contains(lower(cmd_line), '-enc')"))(_sel({"cmd_line|contains|all": ["powershell", "-enc"]}))
query("sigma_re", _ev("regexp_matches(lower(cmd_line), 'cmd[.]exe .* whoami|sc[.]exe create [a-z]+')"))(_sel({"cmd_line|re": ["cmd[.]exe .* whoami", "SC[.]exe create [a-z]+", "([broken"]}))
query("sigma_base64", _ev("contains(summary, 'cHVyY2hhc2U=') OR contains(concat(cmd_line, ''), 'SQBFAFgA')"))(_sel({"cmd_line|base64|contains": ["I\x00E\x00X\x00"]}))
query("sigma_keywords", _ev("contains(lower(concat_ws(chr(1), cmd_line, summary)), 'comsvcs') OR contains(lower(concat_ws(chr(1), cmd_line, summary)), 'code 42')"))(_sel(["COMSVCS", "code 42"]))
query("sigma_selection", _ev("contains(lower(cmd_line), 'svchost') AND lower(username) = 'user-3'"))(
    lambda lake: lake.events.where(r.match_selection({"CommandLine|contains": "svchost", "User": "USER-3"}, r.Fields(lake.events.columns, "process_creation"))).select("id", "summary"))
query("sigma_numeric", _ev("severity_id >= 4 AND dst_port < 100"))(_sel({"severity_id|gte": 4, "dst_port|lt": 100}))


@query("sigma_condition", _ev("(contains(lower(cmd_line), 'lsass') OR contains(lower(cmd_line), 'whoami')) AND NOT coalesce(lower(hostname) = 'host-4', false) AND NOT (severity_id = 1 AND dst_port = 22)"))
def sigma_condition(lake):
    """Precedence, parentheses, '1 of', 'all of'; a missing field is false, so its negation holds."""
    doc = {"id": "c", "detection": {
        "tool_a": {"cmd_line|contains": "lsass"}, "tool_b": {"cmd_line|contains": "whoami"}, "filter_host": {"hostname": "host-4"},
        "low_1": {"severity_id": 1}, "low_2": {"dst_port": 22}, "condition": "1 of tool_* and not filter_host and not (all of low_*)"}}
    ev = lake.events
    return ev.where(r.compile_rule(r.rule_from_dict(doc), ev.columns)).select("id", "summary")


@query("sigma_flatten", "SELECT id, cmd_line AS command_line, process_name AS image, dst_ip AS destination_ip, username AS user_name, class_uid FROM v_events WHERE class_uid IN (1007, 4001)")
def sigma_flatten(lake):
    """Rule field names resolved to event columns at compile time; no flat copy of the event is made."""
    ev = lake.events.where(F.col("class_uid").isin(1007, 4001))
    p, n = r.Fields(ev.columns, "process_creation"), r.Fields(ev.columns, "network_connection")
    return ev.select("id", p("CommandLine").alias("command_line"), p("Image").alias("image"), n("DestinationIp").alias("destination_ip"), n("User").alias("user_name"), "class_uid")


@query("sigma_field_maps", "SELECT id, process_name AS image, username AS target, src_ip AS ip, dst_port AS port FROM v_events")
def sigma_field_maps(lake):
    ev = lake.events
    get = lambda c, f: r.Fields(ev.columns, c)(f)
    return ev.select("id", get("process_creation", "Image").alias("image"), get("authentication", "TargetUserName").alias("target"),
                     get("authentication", "IpAddress").alias("ip"), get("network_connection", "DestinationPort").alias("port"))


@query("sigma_candidates", """SELECT source, class_uid, events, CAST((SELECT count(*) FROM v_rules r WHERE lower(r.logsource_product) = lower(e.source) OR
 r.logsource_category = CASE e.class_uid WHEN 1007 THEN 'process_creation' WHEN 4001 THEN 'network_connection' WHEN 4003 THEN 'dns_query' WHEN 3002 THEN 'authentication' END
 OR (r.logsource_product IS NULL AND r.logsource_category IS NULL AND r.logsource_service IS NULL)) AS BIGINT) AS candidates FROM (SELECT source, class_uid, count(*) AS events FROM v_events GROUP BY 1, 2) e""")
def sigma_candidates(lake):
    return r.candidate_counts(lake.events, lake.rules)


# the same rules as SQL
DETECT_SQL = """
 SELECT id, time_us, hostname, dst_ip, 'ps-encoded' AS rule_id, 4 AS sev, 'T1059.001' AS technique, 'TA0002' AS tactic FROM v_events WHERE class_uid = 1007 AND (cmd_line ILIKE '%-enc%' OR cmd_line ILIKE '%-e %') AND process_name LIKE '%powershell.exe'
 UNION ALL SELECT id, time_us, hostname, dst_ip, 'lsass-access', 5, 'T1003.001', 'TA0006' FROM v_events WHERE class_uid = 1007 AND cmd_line ILIKE '%lsass.exe%' AND process_name NOT IN ('csrss.exe','wininit.exe','wmiprvse.exe')
 UNION ALL SELECT id, time_us, hostname, dst_ip, 'new-service', 3, 'T1543.003', 'TA0003' FROM v_events WHERE class_uid = 1007 AND (cmd_line ILIKE '%sc create%' OR cmd_line ILIKE '%sc.exe create%' OR cmd_line ILIKE '%new-service%')
 UNION ALL SELECT id, time_us, hostname, dst_ip, 'smb-lateral', 4, 'T1021.002', 'TA0008' FROM v_events WHERE class_uid = 4001 AND dst_port IN (445, 139) AND (summary ILIKE '%purchase%' OR summary ILIKE '%psexec%')
 UNION ALL SELECT id, time_us, hostname, dst_ip, 'curl-pipe', 3, 'T1105', 'TA0011' FROM v_events WHERE source = 'Wazuh' AND (cmd_line ILIKE '%base64 -d%' OR cmd_line ILIKE '%whoami%')"""


@query("sigma_detect", f"SELECT id AS event_id, rule_id, coalesce(hostname, dst_ip, '') AS host, sev AS severity_id, technique, tactic FROM ({DETECT_SQL}) t")
def sigma_detect(lake):
    """All bundled rules in one scan; one row per (event, rule)."""
    return al.rule_alerts(lake.events, RULES).select(
        "event_id", "rule_id", "host", "severity_id", F.get("technique_ids", F.lit(0)).alias("technique"), F.get("tactic_ids", F.lit(0)).alias("tactic"))


PER_KIND = 2500  # 10,000 rules in all


def many_rules(per_kind: int = PER_KIND) -> list[r.Rule]:
    """Four kinds of rule, each for many users, codes and hosts."""
    def one(kind: str, i: int, source: dict, detection: dict) -> r.Rule:
        return r.rule_from_dict({"id": f"{kind}-{i}", "title": f"{kind} {i}", "logsource": source, "detection": detection})

    out = []
    for i in range(per_kind):
        out += [
            one("user", i, {"category": "process_creation"}, {"who": {"User": f"USER-{i}"}, "quiet": {"severity_id|lt": 4}, "condition": "who and not quiet"}),
            one("code", i, {"product": "zeek"}, {"code": {"summary|endswith": f"Code {i}"}, "tool-1": {"cmd_line|startswith": "nothing begins so"},
                                                 "tool-2": {"cmd_line|contains": ["lsass", "whoami", "-ENC"]}, "condition": "code and 1 of tool*"}),
            one("pair", i, {}, {"to": {"dst_ip": f"45.33.32.{i}"}, "at": {"hostname|endswith": f"-{i}"}, "condition": "all of them"}),
            one("away", i, {"product": "wazuh"}, {"who": {"username|endswith": f"-{i}"}, "from": {"hostname|contains": f"st-{i}"}, "condition": "who and not from"})]
    return out


_N = f"v_events e JOIN (SELECT CAST(unnest(range({PER_KIND})) AS VARCHAR) AS i) n"


@query("sigma_detect_index", f"""SELECT e.id AS event_id, concat('user-', i) AS rule_id FROM {_N} ON lower(username) = concat('user-', i) WHERE class_uid = 1007 AND NOT coalesce(severity_id < 4, false)
 UNION ALL SELECT e.id, concat('code-', i) FROM {_N} ON ends_with(lower(summary), concat('code ', i)) WHERE lower(source) = 'zeek' AND (contains(cmd_line, 'lsass') OR contains(cmd_line, 'whoami') OR contains(cmd_line, '-enc'))
 UNION ALL SELECT e.id, concat('pair-', i) FROM {_N} ON dst_ip = concat('45.33.32.', i) WHERE ends_with(lower(hostname), concat('-', i))
 UNION ALL SELECT e.id, concat('away-', i) FROM {_N} ON ends_with(lower(username), concat('-', i)) WHERE lower(source) = 'wazuh' AND NOT coalesce(contains(lower(hostname), concat('st-', i)), false)""")
def sigma_detect_index(lake):
    """10,000 rules in one scan, by the index over their distinct tests."""
    return ruleindex.detect(lake.events, many_rules()).select(F.col("id").alias("event_id"), "rule_id")


@query("rule_backtest", _ev("severity_id >= 4 AND lower(source) = 'zeek' AND contains(lower(summary), 'click')"))
def rule_backtest(lake):
    text = "id: t\ntitle: trial\nlogsource: {product: zeek}\ndetection:\n  s: {summary|contains: CLICK}\n  hi: {severity_id|gte: 4}\n  condition: s and hi\n"
    hits, problems = r.backtest(lake.events, text)
    assert not problems
    return hits.select("id", "summary")


@query("rules_load", "SELECT * FROM (VALUES ('ps-encoded', 'high', 'T1059.001', 'TA0002'), ('lsass-access', 'critical', 'T1003.001', 'TA0006'), ('new-service', 'medium', 'T1543.003', 'TA0003'), ('smb-lateral', 'high', 'T1021.002', 'TA0008'), ('curl-pipe', 'medium', 'T1105', 'TA0011')) r(rule_id, level, technique, tactic) JOIN (SELECT rule_id, count(*) AS hits FROM (" + DETECT_SQL + ") t GROUP BY 1) h USING (rule_id)")
def rules_load(lake):
    """Loaded rule texts with the number of events each one matches."""
    return al.rule_alerts(lake.events, RULES).groupBy("rule_id", "level", F.get("technique_ids", F.lit(0)).alias("technique"), F.get("tactic_ids", F.lit(0)).alias("tactic")).agg(F.count("*").alias("hits"))


@query("rules_enabled", "SELECT id, level FROM v_rules WHERE CASE WHEN logsource_product = 'windows' THEN hit_count > 25 ELSE enabled END")
def rules_enabled(lake):
    """Stored rules override shipped ones by id, then disabled rules are skipped."""
    from wardlake.operators.tables import upsert

    shipped = lake.rules.select("id", "level", "enabled")
    stored = lake.rules.where("logsource_product = 'windows'").select("id", "level", F.expr("hit_count > 25").alias("enabled"))
    return upsert(shipped, stored, ["id"]).where("enabled").select("id", "level")


@query("rules_upsert", "SELECT id, CASE WHEN level = 'low' THEN 'critical' ELSE level END AS level FROM v_rules")
def rules_upsert(lake):
    from wardlake.operators.tables import upsert

    return upsert(lake.rules.select("id", "level"), lake.rules.where("level = 'low'").select("id", F.lit("critical").alias("level")), ["id"])
