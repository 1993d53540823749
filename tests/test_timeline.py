import random

import pytest
from pyspark.sql import functions as F

from wardlake.operators import timeline as tl


def greedy(rows, ttl):
    last, kept = {}, []
    for k, t, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        if k not in last or t - last[k] >= ttl:
            last[k] = t
            kept.append((k, t, i))
    return sorted(kept, key=str)


@pytest.mark.parametrize("seed,ttl,slices", [(1, 50, None), (2, 7, 7), (3, 100, 130), (4, 1000, None), (5, 13, 400)])
def test_first_in_ttl_equals_loop(spark, seed, ttl, slices):
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        # one key holds a third of all rows, one key is strictly periodic
        k = rng.choice(["hot", "hot", "a", "b", "c", None])
        rows.append((k, rng.randrange(-200, 20000), i))
    rows += [("tick", 5 * j, 100000 + j) for j in range(800)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    got = [tuple(r) for r in tl.first_in_ttl(df, ["k"], "t", "i", ttl, slices).collect()]
    assert sorted(got, key=str) == greedy(rows, ttl)


def test_small_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(9)
        rows = [(rng.choice(["a", "a", "b"]), rng.randrange(5000), i) for i in range(900)]
        df = spark.createDataFrame(rows, "k string, t long, i long")
        got = [tuple(r) for r in tl.first_in_ttl(df, ["k"], "t", "i", 40, 300).collect()]
        assert sorted(got, key=str) == greedy(rows, 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_assign_anchor_covers_every_row(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(9000), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    kept = tl.anchors(df, ["k"], "t", 90)
    out = tl.assign_anchor(df, kept, ["k"], "t", 90).collect()
    want, last = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in last or t - last[k] >= 90:
            last[k] = t
        want[i] = last[k]
    assert {r["i"]: r["anchor_us"] for r in out} == want


def test_running_sum_crosses_slices(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), rng.randrange(1000), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    out = tl.running_sum(df, ["k"], ["i"], "t", {"total": F.col("v")}, 100).collect()
    want, acc = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        acc[k] = acc.get(k, 0) + v
        want[i] = acc[k]
    assert {r["i"]: r["total"] for r in out} == want


def test_sliding_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), rng.randrange(2000), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    s = tl.sliding(df, "t", 100, 150)
    out = s.withColumn("n", F.count("*").over(tl.sliding_window(["k"], "t", 100))).where("_own").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["n"] == sum(1 for k, t, _ in rows if k == r["k"] and r["t"] - 100 <= t <= r["t"])
