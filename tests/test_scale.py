"""Steps that grew faster than their input: same results, and work that stays in proportion."""

import fnmatch
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from wardlake.operators import dated, enrich
from wardlake.operators import normalizers as nz
from wardlake.operators import packets as pk
from wardlake.operators import rules as ru
from wardlake.sources import lines
from wardlake.streaming import chain as ch
from wardlake.streaming import jobs
from wardlake.streaming import ordered as od

SUPPRESSION = "id long, rule_id string, host string, technique_id string, tactic string, severity string, is_active boolean, expires_us long"
ALERT = "id long, rule_id string, host string, technique_id string, tactic string, severity string"


def test_host_patterns_equal_a_plain_loop(spark):
    rng = random.Random(4)
    hosts = [None, "", "web-1", "WEB-12", "db.corp.example.com", "a" * 40, "b" * 20 + "-x", "web-1\n", "x.y"]
    globs = ["*", "web-?", "WEB-*", "*.corp.example.com", "*corp*", "a*" + "a" * 30, "b" * 17 + "*x", "w*1", "?", "x?y", "web-1", "web-1*1", None]
    some = lambda xs: rng.choice(xs)
    alerts = [(i % 150, some(["r1", "R1", None]), some(hosts), some(["T1", "T2", None]), some(["Impact", None]), some(["low", "HIGH", None])) for i in range(200)]
    rules = [(i, some(["r1", None, None]), some(globs), some(["T1", None, None]), some(["impact", None]), some(["LOW", None, "high"]), i % 7 > 0, None) for i in range(120)]
    want = {}
    low = lambda x: "" if x is None else x.lower()
    for aid, rule, host, tech, tactic, sev in alerts:
        for sid, s_rule, s_host, s_tech, s_tactic, s_sev, active, _ in rules:
            ok = active and (s_rule is None or s_rule == rule) and (s_tech is None or s_tech == tech) and (s_tactic is None or s_tactic == low(tactic)) and (s_sev is None or s_sev.lower() == low(sev))
            if ok and s_host is not None:
                # $ also matches before a line end, . matches none
                ok = host is not None and (fnmatch.fnmatchcase(host.lower().removesuffix("\n"), s_host.lower()) if set("*?") & set(s_host) else host.lower() == s_host.lower())
            if ok:
                want[aid] = min(sid, want.get(aid, sid))
    got = enrich.match_suppressions(spark.createDataFrame(alerts, ALERT), spark.createDataFrame(rules, SUPPRESSION), 0, salts=3).collect()
    assert {r["alert_id"]: r["suppression_id"] for r in got} == want and len(got) == len(want) > 20


def test_many_suppressions_of_one_technique_do_not_meet_all_its_alerts(spark):
    """30,000 patterns ask the same, 30,000 each name hosts of their own: with all pairs tested this takes minutes."""
    rules = spark.range(60_000).select("id", F.lit(None).cast("string").alias("rule_id"), F.when(F.col("id") < 30_000, "host-?").otherwise(F.concat(F.lit("db"), "id", F.lit("-*"))).alias("host"),
                                       F.lit("T1").alias("technique_id"), F.lit(None).cast("string").alias("tactic"), F.lit(None).cast("string").alias("severity"), F.lit(True).alias("is_active"), F.lit(None).cast("long").alias("expires_us"))
    alerts = spark.range(40_000).select("id", F.lit("r").alias("rule_id"), F.concat(F.lit("db"), F.col("id") + 20_000, F.lit("-x")).alias("host"), F.lit("T1").alias("technique_id"), F.lit("t").alias("tactic"), F.lit("low").alias("severity"))
    begun = time.time()
    got = enrich.match_suppressions(alerts, rules, 0).agg(F.count("*"), F.count_if(F.col("suppression_id") == F.col("alert_id") + 20_000)).first()
    assert tuple(got) == (30_000, 30_000)
    assert time.time() - begun < 40


def test_candidate_rules_are_counted_before_they_meet_the_kinds(spark):
    rng = random.Random(8)
    some = lambda xs: rng.choice(xs)
    rules = [(some([None, *range(40)]), some(["zeek", "Wazuh", "linux", None]), some([None, "dns"]), some(["process_creation", "network_connection", "x", None])) for _ in range(90)]
    events = [(some(["Zeek", "wazuh", None, "other"]), some([1007, 4001, 9, None])) for _ in range(80)]
    category = {1007: "process_creation", 4001: "network_connection"}
    want = {}
    for source, kind in events:
        ids = {i for i, product, service, cat in rules if i is not None and (
            source is not None and product is not None and product.lower() == source.lower() or cat is not None and cat == category.get(kind) or product is service is cat is None)}
        want[source, kind] = (events.count((source, kind)), len(ids))
    out = ru.candidate_counts(spark.createDataFrame(events, "source string, class_uid int"), spark.createDataFrame(rules, "id int, logsource_product string, logsource_service string, logsource_category string"))
    assert {(r[0], r[1]): (r[2], r[3]) for r in out.collect()} == want
    many = spark.range(50_000).select("id", F.lit("zeek").alias("logsource_product"), F.lit(None).cast("string").alias("logsource_service"), F.lit(None).cast("string").alias("logsource_category"))
    plan = ru.candidate_counts(spark.createDataFrame(events, "source string, class_uid int"), many)
    assert "HashAggregate(keys=[_filed" in plan._jdf.queryExecution().executedPlan().toString()  # not one row per kind and rule
    assert {r["candidates"] for r in plan.where("lower(source) = 'zeek'").collect()} == {50_000}


def test_first_regular_stretch_equals_a_plain_loop(spark):
    rng = random.Random(6)
    rows, start = [], 1_704_067_200_000_000
    for key in range(25):
        t = start + rng.randrange(3600) * 10**6
        for i in range(rng.randrange(2, 160)):
            t += int(rng.choice([1, 60, 60, 61, 300 if key % 3 else 62]) * 10**6 * rng.choice([1, 1.01, 0.99, 1 if key % 2 else 1.4]))
            rows.append((f"10.0.0.{key}", "8.8.8.8", 443, t, f"f{key}-{i:03}", rng.choice([0, None, 500, 510, 505 if key % 4 else 9000])))
    want = {}
    for key in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[3], r[4])):
            if not kept or r[3] - kept[-1][3] >= 2_000_000:
                kept.append(r)
        for i, r in enumerate(kept):
            w = [x for x in kept[max(0, i - 19) : i + 1] if x[3] >= r[3] - 1800 * 10**6]
            if len(w) < 5:
                continue
            gaps = [(b[3] - a[3]) / 1e6 for a, b in zip(w, w[1:])]
            mean = sum(gaps) / len(gaps)
            jitter = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean * 100
            if jitter < 20:
                p = [x[5] for x in w if (x[5] or 0) > 0]
                mid = sum(p) / len(p) if p else 0
                want[key] = (r[3], len(w), round(mean, 6), round(jitter, 6), len(p) >= 2 and (sum((x - mid) ** 2 for x in p) / len(p)) ** 0.5 / mid < 0.2)
                break
    flows = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, time_us long, flow_id string, bytes_out long")
    out = pk.beacon_multi(flows, "flow_id", "bytes_out", 1800 * 10**6, 5, 20.0, max_samples=20)
    assert {r["src_ip"]: (r["time_us"], r["samples"], round(r["mean_s"], 6), round(r["jitter_pct"], 6), r["steady_payload"]) for r in out.collect()} == want
    assert 5 < len(want) < 25
    assert "collect_list" not in out._jdf.queryExecution().toString()  # no list of the window per contact


def test_regular_contacts_equal_a_plain_loop():
    rng = random.Random(2)
    fired = 0
    for _ in range(300):
        t, times = 0, []
        for _ in range(rng.randrange(1, 60)):
            t += rng.choice([1, 50, 50, 51, 49, rng.randrange(20, 200)]) * 10**6
            times.append(t)
        cut = rng.randrange(len(times) + 1)
        job = jobs.Beacon(40 * 10**6, 4, 0.1, 7)
        got, held = job._next(times[:cut], [])
        if got is None:
            got, held = job._next(times[cut:], held)
        want, kept = None, []
        for t in times:
            if kept and t - kept[-1] < 40 * 10**6:
                continue
            kept = (kept + [t])[-7:]
            gaps = [(b - a) / 1e6 for a, b in zip(kept, kept[1:])]
            if len(kept) >= 4:
                mean = sum(gaps) / len(gaps)
                if (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean <= 0.1:
                    want = (t, len(kept))
                    break
        assert got == want
        fired += want is not None
    assert 20 < fired < 280


def test_streams_with_many_keys_call_the_store_by_bucket(spark, tmp_path):
    """15,000 keys of two rows each, in order and by flow: a round trip to the store per key takes minutes."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        folder = str(tmp_path / "flows")
        flows = spark.range(30_000).select(F.concat(F.lit("a"), F.col("id") % 15_000).alias("src_ip"), F.lit("b").alias("dst_ip"), F.lit(1).alias("dst_port"), (F.lit(1_704_067_200_000_000) + F.col("id") * 1000).alias("time_us"), F.col("id").cast("string").alias("flow_id"), F.lit(40).cast("long").alias("bytes"))
        flows.withColumn("time", F.timestamp_micros("time_us")).coalesce(1).write.parquet(folder)
        keys = ["src_ip", "dst_ip", "dst_port"]
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        begun = time.time()
        out = od.run_in_order(stream, "many", lambda r: od.in_order(r, keys, ["time_us", "flow_id", "bytes"], od.volume_step(60, 60_000_000), "anchor_us long, time_us long, total_bytes long", "1 minute"))
        assert tuple(out.agg(F.count("*"), F.min("total_bytes"), F.count_distinct("src_ip")).first()) == (15_000, 80, 15_000)
        contacts = jobs.run_available(jobs.beacon(stream, gap_us=1, min_samples=2), "contacts")
        assert contacts.count() == 15_000
        assert time.time() - begun < 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_days_without_rows_are_dropped_together(spark, monkeypatch, tmp_path):
    table = "scale_days_dropped"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    rows = spark.range(7).select("id", (F.lit(1_704_067_200_000_000) + F.col("id") * 86_400_000_000).alias("time_us"))
    said = []
    try:
        dated.create(rows, table, "id")
        run = type(spark).sql
        monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (said.append(text), run(self, text, *a, **k))[1])
        counts = dated.delete_rows(spark, table, F.col("id") < 5)
        assert counts.count() == 5 and sorted(r["id"] for r in spark.table(table).collect()) == [5, 6]
        assert len([s for s in said if s.startswith("ALTER TABLE")]) == 1
    finally:
        monkeypatch.undo()
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_intake_packs_its_table(spark, tmp_path):
    folder = str(tmp_path / "raw")
    spark.createDataFrame([("x1", "other", "{broken")], "line_id string, source string, line string").write.parquet(folder)
    intake = ch.Intake(spark, {"zeek": lambda rows: nz.zeek(lines.parse_zeek_json(rows.withColumn("value", F.col("line"))), "conn", ["line_id", "line"])}, 60_000)
    intake.take(spark.readStream.schema("line_id string, source string, line string").parquet(folder))
    assert [r["kind"] for r in intake.table().collect()] == ["dead"]
    assert all(name.endswith(".zstd.parquet") for name in intake.table().inputFiles())


def test_rows_of_a_stream_wait_in_packed_entries(spark, tmp_path):
    """20,000 rows that wait for the watermark are a few entries of each bucket's state, not one each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        folder = str(tmp_path / "flows")
        flows = spark.range(20_000).select(F.concat(F.lit("a"), F.col("id") % 3_000).alias("src_ip"), (F.lit(1_704_067_200_000_000) + F.col("id") * 1000).alias("time_us"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("flow_id"), F.when(F.col("id") % 5 > 0, F.col("id") * 3).alias("bytes"))
        flows.withColumn("time", F.timestamp_micros("time_us")).coalesce(1).write.parquet(folder)
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        query = od.Job(spark, "packed")
        closing = od.Closing(spark, query.base)
        df = od.in_order(closing.attach(stream), ["src_ip"], ["time_us", "flow_id", "bytes"], lambda rows, _: (rows, None, None), "time_us long, flow_id string, bytes long", "1 hour")
        first = query.drain(df)
        closing.end()
        query.drain(df)
        assert 0 < max(od.state_rows(first)) <= 6 * od.BUCKETS
        assert Counter(map(tuple, query.result(df.schema).collect())) == Counter(map(tuple, flows.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_intake_reads_each_source_once(spark, tmp_path):
    folder = str(tmp_path / "raw")
    rows = [("z1", "zeek", '{"ts":"1704067200.5","uid":"u","id.orig_p":"7"}'), ("z2", "zeek", '{"ts":"x","uid":"u"}'), ("z3", "zeek", "[1]"), ("z4", "zeek", "{broken"), ("o1", "other", "{}"), ("n1", None, "{}")]
    spark.createDataFrame(rows, "line_id string, source string, line string").write.parquet(folder)
    whole = ch.read_batch(spark.read.parquet(folder), {"zeek": lambda r: nz.zeek(lines.parse_zeek_json(r.withColumn("value", F.col("line")), only=nz.ZEEK_CONN), "conn", ["line_id", "line"])})
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # its events and dead letters; lines that are no records
    got = {r["line_id"]: (r["kind"], r["error_type"], r["source"], r["line"], r["src_port"]) for r in whole.collect()}
    dead = {i: ("dead", "schema_validation" if i == "z2" else "parse_error", s, line, None) for i, s, line in rows[1:]}
    assert got == {"z1": ("event", None, "Zeek", None, 7)} | dead


def test_a_table_of_very_many_days_has_few_folders(spark):
    """2,000 days of a row each are months; rows, counts and the periods that stay are as with days."""
    table = "scale_many_days"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    day = 86_400_000_000
    rows = spark.range(2001).select("id", F.when(F.col("id") < 2000, F.lit(1_704_067_200_000_000) + F.col("id") * day).alias("time_us"))
    try:
        dated.create(rows, table, "id")
        folders = {r["day"] for r in spark.table(table).select("day").distinct().collect()}
        assert len(folders) <= dated.FOLDERS and {"2024-01", "2024-12", "undated"} <= folders
        old = F.col("time_us") < 1_704_067_200_000_000 + 40 * day
        assert {tuple(r) for r in dated.delete_rows(spark, table, old).collect()} == {("2024-01", 31, 0), ("2024-02", 9, 20)}
        assert sorted(r["id"] for r in spark.table(table).collect()) == list(range(40, 2001))
        done = dated.update_rows(spark, table, spark.createDataFrame([(50, 7), (9999, 8)], "id long, time_us long")).collect()
        assert [tuple(r) for r in done] == [(1, 1)]
        assert spark.table(table).where("id = 50").select("time_us", "day").collect() == [(7, "2024-02")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_regular_contacts_of_busy_and_quiet_keys_equal_a_plain_loop(spark):
    """Keys that are never silent for the gap, ties, missing ids and keys; ids travel once and are gone from what follows."""
    rng = random.Random(9)
    rows, start = [], 1_704_067_200_000_000 + 17 * 3_600_000_000 + 3_560_000_000  # just before the evening
    for key in range(14):
        t = start + rng.randrange(200) * 10**6
        for i in range(rng.randrange(700, 1100) if key % 2 else rng.randrange(20, 120)):
            step = rng.choice([0, 400_000, 900_000, 1_000_000, 1_600_000 if key % 4 == 1 else 2_000_000]) if key % 2 else rng.choice([0, 1_500_000, 61_000_000, 60_000_000, 90_000_000 if key % 4 else 61_000_000])
            t += step
            rows.append((f"10.0.0.{key}", "8.8.8.8" if i % 50 else None, 443 + key % 2, t, f"f{rng.randrange(10**6):06}" if i % 9 or key % 3 else None, rng.choice([0, None, 500, 510, 505])))
    rows.append(("10.0.0.0", "8.8.8.8", 443, None, "x", 1))
    want = {}
    for key in {r[0] for r in rows}:
        last, kept = None, []
        of_key = sorted((r for r in rows if r[0] == key and r[1] and r[3] is not None), key=lambda r: (r[3], r[4] is None, r[4]))
        for r in of_key:
            if last is None or r[3] - last >= 2_000_000:
                last = r[3]
                if r[4] is not None:  # an instant without any id holds the gap but is no contact
                    kept.append(r)
        off = 0
        for i, r in enumerate(kept):
            off += (r[3] // 3_600_000_000) % 24 >= 18 or (r[3] // 3_600_000_000) % 24 < 8
            w = [x for x in kept[max(0, i - 19) : i + 1] if x[3] >= r[3] - 1800 * 10**6]
            gaps = [(b[3] - a[3]) / 1e6 for a, b in zip(w, w[1:])]
            if len(w) < 5:
                continue
            mean = sum(gaps) / len(gaps)
            if (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean * 100 < 12:
                want[key] = (r[3], len(w), round(mean, 6), round(off / len(w) * 100, 6))
                break
    flows = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, time_us long, flow_id string, bytes_out long")
    out = pk.beacon_multi(flows.repartition(5), "flow_id", "bytes_out", 1800 * 10**6, 5, 12.0, max_samples=20)
    got = {r["src_ip"]: (r["time_us"], r["samples"], round(r["mean_s"], 6), round(r["off_hours_pct"], 6)) for r in out.collect()}
    assert got == want and len(want) > 6
    assert {int(k.rsplit(".")[-1]) % 2 for k in want} == {0, 1} and any(x[3] > 0 for x in want.values())
    assert "flow_id" not in out._jdf.queryExecution().toString()
