"""Detectors at their default thresholds on small fixtures, and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from wardlake.functions import domains
from wardlake.operators import alerts, flows, packets, rollups

S = 1_000_000
FLOW = "flow_id string, time_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, bytes_in long, bytes_out long, duration_ms int"


def flow(i, t, src="10.0.0.1", dst="192.168.1.1", port=80, b_in=0, b_out=0, ms=0):
    return (f"f{i:05d}", int(t * S), src, dst, 40000, port, "TCP", b_in, b_out, ms)


def test_port_scan_edge(spark):
    rows = [flow(i, i, port=100 + i) for i in range(15)] + [flow(100 + i, i, dst="192.168.1.2", port=100 + i) for i in range(14)]
    out = flows.port_scan(spark.createDataFrame(rows, FLOW)).collect()
    assert [(r["dst_ip"], r["ports"]) for r in out] == [("192.168.1.1", 15)]


def test_port_scan_window_is_half_open(spark):
    # the first port leaves exactly 300 s later
    rows = [flow(0, 0, port=1)] + [flow(i, 10 + i, port=1 + i) for i in range(1, 14)] + [flow(20, 300, port=99)]
    assert flows.port_scan(spark.createDataFrame(rows, FLOW)).count() == 0
    rows[-1] = flow(20, 299.999999, port=99)
    assert flows.port_scan(spark.createDataFrame(rows, FLOW)).count() == 1


def test_port_scan_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [flow(i, rng.randrange(3000), src=rng.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2"]), port=rng.randrange(12)) for i in range(900)]
    got = {(r["src_ip"], r["time_us"]): r["ports"] for r in flows.port_scan(spark.createDataFrame(rows, FLOW), 5, 60 * S).collect()}
    want = {}
    for r in rows:
        n = len({x[5] for x in rows if x[2] == r[2] and r[1] - 60 * S < x[1] <= r[1]})
        if n >= 5:
            want[r[2], r[1]] = n
    assert got == want


def test_dns_bytes_edge(spark):
    rows = [flow(0, 0, port=53, b_out=100), flow(1, 0, port=53, b_out=101)]
    assert [r["flow_id"] for r in flows.dns_flow_tunnel(spark.createDataFrame(rows, FLOW)).collect()] == ["f00001"]


@pytest.mark.parametrize("spread,hits", [(0, 1), (10, 1), (13, 0)])
def test_beacon_jitter_edge(spark, spread, hits):
    # gaps alternate 60 - d, 60 + d: jitter d / 60
    t, rows = 0, []
    for i in range(12):
        rows.append(flow(i, t, dst="45.33.32.1", port=443))
        t += 60 + (spread if i % 2 else -spread)
    out = flows.beacon(spark.createDataFrame(rows, FLOW), slice_us=100 * S).collect()
    assert len(out) == hits


def test_brute_force_edge(spark):
    nine = [flow(i, i * 10, port=22, ms=100, b_in=100) for i in range(9)]
    long_one = [flow(50, 95, port=22, ms=2001, b_in=100)]
    assert flows.brute_force(spark.createDataFrame(nine + long_one, FLOW)).count() == 0
    assert flows.brute_force(spark.createDataFrame(nine + [flow(51, 95, port=22, ms=2000, b_in=1000)], FLOW)).count() == 1


def test_exfil_baseline_first_crossing(spark):
    rows = [flow(i, i * 2000, dst="45.33.32.1", b_out=100) for i in range(10)]
    r = flows.exfil_baseline(spark.createDataFrame(rows, FLOW), 300).collect()
    assert [(x["flow_id"], x["total_bytes"]) for x in r] == [("f00006", 700)]


def test_lateral_first_and_known(spark):
    rows = [flow(0, 5, port=445), flow(1, 4, port=22), flow(2, 1, dst="192.168.1.9", port=3389), flow(3, 0, port=80)]
    df = spark.createDataFrame(rows, FLOW)
    known = spark.createDataFrame([("10.0.0.1", "192.168.1.9")], "src_ip string, dst_ip string")
    assert [(r["flow_id"], r["service"]) for r in flows.lateral_first_seen(df, known).collect()] == [("f00001", "SSH")]


def scan_loop(rows, window, threshold):
    """Plain state machine: reset when the window is over, fire and reset when enough ports were seen."""
    state, out = {}, []
    for src, t, i, port in sorted(rows, key=lambda r: (r[1], r[2])):
        ports, start = state.get(src, (set(), t))
        if t - start > window:
            ports, start = set(), t
        ports = ports | {port}
        if len(ports) >= threshold:
            out.append((src, t, start))
            ports, start = set(), t
        state[src] = (ports, start)
    return sorted(out)


@pytest.mark.parametrize("seed,slices", [(1, None), (2, 61), (3, 75), (4, 150), (5, 400)])
def test_packet_scan_equals_loop(spark, seed, slices):
    rng = random.Random(seed)
    rows = []
    for i in range(2500):
        rows.append((rng.choice(["hot", "hot", "hot", "b", "c"]), rng.randrange(4000) if i % 3 else rng.randrange(300), i, rng.randrange(25)))
    df = spark.createDataFrame(rows, "src_ip string, time_us long, id long, dst_port int")
    got = sorted((r["src_ip"], r["time_us"], r["window_start_us"]) for r in packets.port_scan(df, "id", 6, 60, slices).collect())
    assert got == scan_loop(rows, 60, 6)


def test_correlation_window_is_inclusive(spark):
    rows = [(1, 0, "critical"), (2, 3600, "low"), (3, 3601, "low"), (4, 3602, "high"), (5, 3700, "critical")]
    df = spark.createDataFrame([(i, "h", "t", s, sec * S) for i, sec, s in rows], "id long, host string, tactic string, severity string, time_us long")
    out = {r["id"]: r["anchor_us"] // S for r in alerts.correlate(df).collect()}
    assert out == {1: 0, 2: 0, 4: 3602, 5: 3602}


def test_recurrence_excludes_self_and_old(spark):
    rows = [("r", "h", 0), ("r", "h", 86400), ("r", "h", 86401), ("r", "x", 86401)]
    df = spark.createDataFrame([(a, b, t * S) for a, b, t in rows], "rule_id string, host string, time_us long")
    got = {(r["host"], r["time_us"] // S): r["recurrence"] for r in alerts.recurrence(df, ["rule_id", "host"]).collect()}
    assert got == {("h", 0): 0, ("h", 86400): 1, ("h", 86401): 1, ("x", 86401): 0}


def test_entropy_and_dga(spark):
    from wardlake.functions.text import shannon_entropy

    df = spark.createDataFrame([("google",), ("xk3j9f2mq8p1",), ("",)], "s string")
    a, b, c = [r[0] for r in df.select(shannon_entropy(F.col("s"))).collect()]
    assert a < 3.5 < b and c == 0.0
    names = spark.createDataFrame([("a3f9c1e07b2d4f68.com",), ("wikipedia.org",), ("qwxzvbnmkjhgf.biz",), ("x8f3k2.cloudfront.net",)], "q string")
    out = {r["q"]: r["severity"] for r in domains.dga(names, "q").collect()}
    assert out["a3f9c1e07b2d4f68.com"] == "high" and "wikipedia.org" not in out and "x8f3k2.cloudfront.net" not in out


def test_sequence_needs_order_and_window(spark):
    rows = [("a", 0, "A"), ("a", 5, "B"), ("a", 9, "C"), ("b", 0, "B"), ("b", 1, "A"), ("b", 2, "C"), ("c", 0, "A"), ("c", 1, "B"), ("c", 200, "C")]
    df = spark.createDataFrame(rows, "host string, time_us long, technique_id string")
    got = [tuple(r) for r in rollups.sequence_chain(df, "host", ["A", "B", "C"], 100).collect()]
    assert got == [("a", 0, 9)]
