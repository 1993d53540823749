"""Deletes and updates of stored tables: rows, counts, and which files are replaced."""

import uuid

import pytest
from pyspark.sql import functions as F

from wardlake.operators import dated

HOUR = 3_600_000_000


@pytest.fixture
def table(spark, tmp_path_factory):
    name = f"dated_{uuid.uuid4().hex}"
    rows = [(i, i * HOUR if i != 99 else None, "active" if i % 3 else None, f"t{i}") for i in range(100)]
    dated.create(spark.createDataFrame(rows, "id long, time_us long, status string, title string"), name, "id")
    yield name
    spark.sql(f"DROP TABLE {name}")


def files(spark, name):
    """Files by day."""
    rows = spark.table(name).select("day", F.col("_metadata.file_name").alias("f")).distinct().collect()
    out = {}
    for r in rows:
        out.setdefault(r["day"], set()).add(r["f"])
    return out


def test_delete(spark, table):
    before = files(spark, table)
    assert set(before) == {"1970-01-01", "1970-01-02", "1970-01-03", "1970-01-04", "1970-01-05", "undated"}
    # the first day goes whole, the second in part; rows without a time give null and stay
    counts = dated.delete_rows(spark, table, F.col("time_us") < 30 * HOUR)
    assert {tuple(r) for r in counts.collect()} == {("1970-01-01", 24, 0), ("1970-01-02", 6, 18)}
    after = files(spark, table)
    assert "1970-01-01" not in after and not after["1970-01-02"] & before["1970-01-02"]
    assert all(after[d] == before[d] for d in before if d > "1970-01-02")
    assert sorted((r["id"], r["title"]) for r in spark.table(table).collect()) == [(i, f"t{i}") for i in range(30, 100)]
    assert dated.delete_rows(spark, table, F.col("time_us") < 30 * HOUR).collect() == []
    assert files(spark, table) == after
    dated.delete_rows(spark, table, F.lit(True))
    assert spark.table(table).count() == 0
    assert dated.delete_rows(spark, table, F.lit(True)).collect() == []


def test_update(spark, table):
    before = files(spark, table)
    changes = spark.createDataFrame([(50, "resolved", None), (50, "closed", None), (51, None, "new title"), (99, "resolved", "x"), (7000, "resolved", None), (None, "lost", None)], "id long, status string, title string")
    assert [tuple(r) for r in dated.update_rows(spark, table, changes).collect()] == [(3, 1)]
    got = {r["id"]: (r["status"], r["title"], r["day"]) for r in spark.table(table).collect()}
    want = {i: ("active" if i % 3 else None, f"t{i}", f"1970-01-0{1 + i // 24}" if i != 99 else "undated") for i in range(100)}
    want |= {50: ("resolved", "t50", "1970-01-03"), 51: (None, "new title", "1970-01-03"), 99: ("resolved", "x", "undated")}
    assert got == want
    after = files(spark, table)
    assert {d for d in before if before[d] != after[d]} == {"1970-01-03", "undated"}
    assert [tuple(r) for r in dated.update_rows(spark, table, changes.where("id = 7000")).collect()] == [(0, 1)]
    assert [tuple(r) for r in dated.update_rows(spark, table, changes.limit(0)).collect()] == [(0, 0)]
    assert files(spark, table) == after
