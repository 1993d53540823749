"""Routing rules as a list, against a plain loop over every alert and channel."""

import json
import random
import re

from wardlake.operators import routing

RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1}
ALERT = "id int, severity string, host string, rule_name string, tactic_ids array<string>, technique_ids array<string>"
CHANNEL = "id int, enabled boolean, min_severity string, routing_rules string"


def values(field, a):
    _, severity, host, name, tactics, techniques = a
    return {"severity": [(severity or "").lower()], "host": [(host or "").lower()], "rule_name": [(name or "").lower()],
            "tactic": [(t or "").lower() for t in tactics or []], "technique_id": [(t or "").upper() for t in techniques or []]}.get(field, [])


def meets(rule, a):
    got, want, op = values(rule.get("field"), a), rule.get("value"), rule.get("operator")
    if not got or want is None:
        return False
    if op == "in":
        return isinstance(want, list) and any(v in (w.lower(), w.upper()) for v in got for w in want)
    if op == "eq":
        return any(v in (want.lower(), want.upper()) for v in got)
    if op == "ne":
        return not any(v in (want.lower(), want.upper()) for v in got)
    if op == "contains":
        return any(want.lower() in v for v in got)
    if op == "regex":
        try:
            return any(re.search(want, v, re.I) for v in got)
        except re.error:
            return False
    return False


def loop(alerts, channels):
    out = set()
    for a in alerts:
        for i, enabled, floor, text in channels:
            rules = json.loads(text) if text else []
            if enabled and RANK.get((a[1] or "").lower(), 0) >= RANK.get(floor, 0) and (not rules or any(meets(r, a) for r in rules)):
                out.add((a[0], i))
    return out


def got(spark, alerts, channels, **kw):
    rows = routing.route(spark.createDataFrame(alerts, ALERT), spark.createDataFrame(channels, CHANNEL), **kw).select("id", "channel_id").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_equals_a_plain_loop(spark):
    rng = random.Random(11)
    words = {"severity": ["critical", "high", "Low"], "host": ["web-1", "WEB-2", "db"], "rule_name": ["Mimikatz", "port scan"],
             "tactic": ["TA0001", "ta0002", "TA0003"], "technique_id": ["T1059", "t1003.001", "T1078", "1059"], "colour": ["red"]}

    def some(field, n):
        return [rng.choice([*words[field], None]) for _ in range(rng.randrange(n))]

    alerts = [(i, rng.choice(["critical", "HIGH", "low", "odd", None]), rng.choice([*words["host"], None]), rng.choice([*words["rule_name"], None]),
               rng.choice([None, some("tactic", 4)]), rng.choice([None, some("technique_id", 4)])) for i in range(150)]
    channels = []
    for i in range(120):
        rules = []
        for _ in range(rng.randrange(4)):
            field, op = rng.choice(list(words)), rng.choice([*routing.OPERATORS, "like"])
            value = rng.choice(words[field])
            if op == "in":
                value = rng.choice([value, words[field][:2], [value.lower()], []])
            elif op == "regex":
                value = rng.choice(["^" + value[:2], "([", value + "$", "."])
            elif op == "contains":
                value = rng.choice([value, value[1:3], "05"])
            rules.append({"field": field, "operator": op, "value": value})
        channels.append((i, rng.random() < 0.9, rng.choice(list(RANK)), json.dumps(rules) if rules else rng.choice([None, "", "[]"])))
    assert got(spark, alerts, channels) == loop(alerts, channels)


def test_rules_that_are_no_list_match_nothing(spark):
    alert = [(1, "critical", "h", "r", ["TA0001"], ["T1059"])]
    texts = ["not json", '[{"operator":"eq","value":"h"}]', '[{"field":"host","operator":"ne"}]', '[{"field":"host","operator":"eq","value":"h"}]']
    assert got(spark, alert, [(i, True, "low", t) for i, t in enumerate(texts)]) == {(1, 3)}


def test_repeated_alerts_and_empty_tables(spark):
    alert, channel = (1, "high", None, None, None, None), (7, True, "low", None)
    twice = routing.route(spark.createDataFrame([alert, alert], ALERT), spark.createDataFrame([channel], CHANNEL))
    assert twice.count() == 2
    assert got(spark, [], [channel]) == set() and got(spark, [alert], []) == set()


def test_many_tests_of_one_field_span_blocks(spark):
    alerts = [(i, "high", f"host-{i}", "r", [], []) for i in range(40)]
    channels = [(i, True, "low", json.dumps([{"field": "host", "operator": "contains", "value": f"-{i % 40}"}])) for i in range(600)]
    assert got(spark, alerts, channels) == loop(alerts, channels)


def test_indicator_types_are_told_apart(spark):
    from pyspark.sql import functions as F

    from wardlake.operators import enrich

    md5, sha = "a" * 32, "b" * 64
    rows = [(1, "h1", "1.2.3.4", None, "evil.example", sha, None, " http://x/y "), (2, None, "", "9.9.9.9", None, md5, None, None), (3, "", None, None, " ", "short", sha, "")]
    ev = spark.createDataFrame(rows, "id int, hostname string, src_ip string, dst_ip string, domain string, process_hash string, hash_sha256 string, url string")
    found = ev.select("id", F.explode(enrich.row_candidates(ev)).alias("c")).select("id", "c.*").collect()
    assert {tuple(r) for r in found} == {
        (1, "ip", "h1"), (1, "domain", "h1"), (1, "ip", "1.2.3.4"), (1, "domain", "evil.example"), (1, "url", "http://x/y"), (1, "hash_sha256", sha),
        (2, "ip", "9.9.9.9"), (2, "hash_md5", md5), (3, "hash_sha256", sha)}
