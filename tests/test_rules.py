"""Rule conditions, modifiers and their two-valued logic; suppression and routing."""

import pytest
from pyspark.sql import functions as F

from wardlake.functions import endpoint, protocols, tagging
from wardlake.operators import enrich, rules, tables

COLS = "id int, class_uid int, source string, cmd_line string, hostname string, dst_ip string, severity_id int"


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame([
        (1, 1007, "Zeek", "powershell -enc AAAA", "h1", "10.0.0.1", 1), (2, 1007, "Zeek", "cmd whoami", None, "192.168.5.9", 2),
        (3, 4001, "Wazuh", None, "h2", "8.8.8.8", 3), (4, 4001, "Wazuh", "PSEXEC \\\\srv", "h3", "not-an-ip", 4)], COLS)


def hits(ev, selections, condition):
    doc = {"id": "x", "detection": {**selections, "condition": condition}}
    return sorted(r["id"] for r in ev.where(rules.compile_rule(rules.rule_from_dict(doc), ev.columns)).collect())


@pytest.mark.parametrize("cond,want", [
    ("a", [1]), ("not a", [2, 3, 4]), ("a or b and c", [1, 2]), ("(a or b) and c", [2]), ("not a and b", [2]), ("1 of them", [1, 2, 3, 4]), ("all of a*", [1]), ("1 of zz*", []), ("all of zz*", []), ("not (a or b)", [3, 4])])
def test_conditions(ev, cond, want):
    sel = {"a": {"cmd_line|contains": "-ENC"}, "b": {"cmd_line|contains": "whoami"}, "c": {"severity_id|gte": 2}}
    assert hits(ev, sel, cond) == want


@pytest.mark.parametrize("sel,want", [
    ({"cmd_line|re": "^cmd .*i$"}, [2]), ({"cmd_line|re": "([bad"}, []), ({"dst_ip|cidr": ["10.0.0.0/8", "192.168.0.0/16"]}, [1, 2]), ({"dst_ip|cidr": "nonsense"}, []),
    ({"cmd_line|contains|all": ["power", "enc"]}, [1]), ({"hostname": ["H1", "h3"]}, [1, 4]), ({"hostname": "h*"}, []), ({"missing": "x"}, []), ({"hostname": None}, [2]),
    (["whoami", "8.8.8.8"], [2, 3]), ({"cmd_line|endswith": "SRV"}, [4])])
def test_modifiers(ev, sel, want):
    assert hits(ev, {"s": sel}, "s") == want


def test_bad_rules_are_left_out_and_guards_hold(ev):
    docs = [{"id": "1", "title": "ok", "logsource": {"category": "process_creation"}, "detection": {"s": {"severity_id|gte": 1}, "condition": "s"}},
            {"id": "2", "title": "broken", "detection": {"s": {"a": 1}, "condition": "s and ("}}, "nonsense: [",
            {"id": "3", "title": "service only", "logsource": {"service": "x"}, "detection": {"s": {"severity_id|gte": 1}, "condition": "s"}},
            {"id": "4", "title": "off", "enabled": False, "detection": {"s": {"severity_id|gte": 1}, "condition": "s"}}]
    out = rules.detect(ev.withColumn("time_us", F.lit(0)), rules.load_rules(docs)).collect()
    assert sorted((r["id"], r["rule_id"]) for r in out) == [(1, "1"), (2, "1")]


def test_suppression_wildcards(spark):
    a = spark.createDataFrame([(1, "r1", "Host-1", "T1", "Execution", "low"), (2, "r2", "db-9", None, "Impact", "high"), (3, "r3", "web", "T9", None, None)],
                              "id int, rule_id string, host string, technique_id string, tactic string, severity string")
    s = spark.createDataFrame([(10, "R1", None, None, None, None, True, None), (11, None, "host-?", None, None, "LOW", True, None), (12, None, "db-*", None, "impact", None, True, 5), (13, None, None, None, "IMPACT", None, True, 200),
                               (14, None, None, None, None, None, False, None), (15, None, "WEB", None, None, None, True, None), (16, None, "w.b", None, None, None, True, None)],
                              "id int, rule_id string, host string, technique_id string, tactic string, severity string, is_active boolean, expires_us long")
    got = {r["alert_id"]: r["suppression_id"] for r in enrich.match_suppressions(a, s, 100, salts=3).collect()}
    assert got == {1: 11, 2: 13, 3: 15}
    everything = s.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None, None, True, None)], s.schema))
    assert enrich.match_suppressions(a, everything, 100).count() == 3


def test_geo_wide_and_nested_networks(spark):
    geo = spark.createDataFrame([(1, "45.0.0.0/8", "wide"), (2, "45.33.32.0/24", "narrow"), (3, "bad", "x")], "id int, network string, country string")
    ips = spark.createDataFrame([("45.33.32.7",), ("45.9.9.9",), ("8.8.8.8",), ("x",)], "ip string")
    assert {r["ip"]: r["country"] for r in enrich.geo_lookup(ips, geo).collect()} == {"45.33.32.7": "narrow", "45.9.9.9": "wide"}


def test_tags(spark):
    df = spark.createDataFrame([("sudo", "sudo rm -rf /", None, 0, 1), ("python3", "python3 -c x", "/tmp/python3", 0, 5), ("ls", "ls", "/bin/ls", 1, 1)], "name string, cmd_line string, exe_path string, uid int, ppid int")
    got = [r["technique_ids"] for r in tagging.with_process_tags(df).collect()]
    assert got[0] == ["T1134", "T1548", "T1548.003"]
    assert got[1] == ["T1036", "T1036.005", "T1059", "T1059.006", "T1068", "T1218"]
    assert got[2] == ["T1083"]


def test_payload_signatures(spark):
    texts = [b"GET / HTTP/1.1", b"SSH-2.0", b"\x16\x03\x01", b"\x00\x01\x01\x00\x00\x01\x00\x00\x00\x00\x00\x00", b"zz", b""]
    df = spark.createDataFrame([(bytearray(t),) for t in texts], "p binary")
    assert [r[0] for r in df.select(protocols.observed_protocol(F.col("p"))).collect()] == ["http", "ssh", "tls", "dns", None, None]


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    got = {r["id"]: r["v"] for r in tables.upsert(old.withColumn("seq", F.lit(0)), new, ["id"], "seq").collect()}
    assert got == {1: "a", 2: "d", 3: "e"}
    diff = {r["id"]: r["change"] for r in tables.snapshot_diff(old, new.where("seq = 1"), "id", "v").collect()}
    assert diff == {1: "Delete", 2: "Modify", 3: "Create"}


def test_exclusions(spark):
    df = spark.createDataFrame([("a.log",), ("temp",), ("temp2",)], "n string")
    assert [r["n"] for r in df.where(~endpoint.excluded(F.col("n"), ["*.log", "temp"])).collect()] == ["temp2"]
