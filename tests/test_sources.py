"""Readers and writers over files, and the registry."""

import json

from pyspark.sql import functions as F

from wardlake.operators import normalizers as nz
from wardlake.sources import lines, readers, sinks


def test_zeek_file_both_forms(spark, tmp_path):
    p = tmp_path / "conn.log"
    p.write_text("#separator\n" + json.dumps({"ts": 1.5, "uid": "J", "id.orig_h": "10.0.0.1", "id.orig_p": 1, "id.resp_h": "45.33.32.1", "id.resp_p": "80", "conn_state": "REJ"}) + "\n{broken\n2.5\tT\t10.0.0.2\t2\t45.33.32.2\tx\ttcp\n")
    out = {r["uid"]: r for r in readers.read_zeek(spark, str(p), "conn").collect()}
    assert set(out) == {"J", "T"} and out["J"]["id.resp_p"] == 80 and out["T"]["id.resp_p"] is None and out["T"]["_path"] == "conn"


def test_syslog_edges(spark):
    rows = ["<34>1 2024-01-01T00:00:00Z - app - - - hello", "<13>Feb  5 17:32:18 10.0.0.99 Use the BFG!", "plain text", '<165>1 - h a 1 m [x@1 k="a\\]b"][y] msg', "<13>odd"]
    out = lines.parse_syslog(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [(r["hostname"], r["app_name"], r["message"]) for r in out] == [
        (None, "app", "hello"), ("10.0.0.99", None, "Use the BFG!"), (None, None, "plain text"), ("h", "a", "msg"), (None, None, "odd")]
    assert out[0]["facility_name"] == "auth" and out[0]["severity_name"] == "critical" and out[2]["facility"] is None


def test_events_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("1.5", "U", "10.0.0.1", "1", "45.33.32.1", "80", "S0")], "ts string, uid string, a string, b string, c string, d string, s string")
    text = raw.select(F.to_json(F.struct("ts", "uid", F.col("a").alias("id.orig_h"), F.col("b").alias("id.orig_p"), F.col("c").alias("id.resp_h"), F.col("d").alias("id.resp_p"), F.col("s").alias("conn_state"))).alias("value"))
    ev = nz.zeek(lines.parse_zeek_json(text))
    sinks.write_events(ev, str(tmp_path / "ev"))
    back = readers.scan_events(spark, str(tmp_path / "ev")).collect()
    assert [(r["event_uid"], r["severity_id"], r["src_ip"], str(r["date"])) for r in back] == [("U", 2, "10.0.0.1", "1970-01-01")]


def test_unreadable_time_is_a_dead_letter(spark):
    df = spark.createDataFrame([("nope", "1")], "timestamp string, id string")
    from wardlake.sources.documents import SCHEMAS

    wide = spark.createDataFrame([], SCHEMAS["wazuh"]).unionByName(df, allowMissingColumns=True)
    ok, dead = nz.split_valid(nz.wazuh(wide))
    assert ok.count() == 0 and [r["error_type"] for r in dead.collect()] == ["schema_validation"]


def test_alert_files_and_csv(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("time_us"), F.lit(None).cast("string").alias("host"))
    sinks.write_alerts_jsonl(df, str(tmp_path / "a"), max_per_file=3)
    assert spark.read.json(str(tmp_path / "a")).count() == 10
    sinks.write_csv_page(df, str(tmp_path / "c"), ["id", "host"], limit=4)
    assert [r["id"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["9", "8", "7", "6"]


def test_registry_and_flagship(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_scan_reaches_parquet(spark):
    import __spark_entry__ as e

    plan = e.queries()["search_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1].split(">")[0]
