"""Event reduction: roll-ups, state changes, sampling, sequences, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.operators import timeline as tl


def conn_rollup(flows: DataFrame, minutes: int = 10, floor: int = 1) -> DataFrame:
    """Per (dst, port, protocol) and window: flows, distinct sources, bytes, first and last.

    Distinct sources go through (group, source) partial aggregates, so a busy service is spread
    over its sources.
    """
    win = F.floor(F.col("time_us") / (minutes * 60 * tl.SECOND)).cast("long").alias("bucket")
    keys = ["dst_ip", "dst_port", "protocol", "bucket"]
    per = flows.withColumn("bucket", win).groupBy(*keys, "src_ip").agg(
        F.count("*").alias("n"), F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("b"), F.min("time_us").alias("lo"), F.max("time_us").alias("hi"))
    return per.groupBy(*keys).agg(F.sum("n").alias("flows"), F.count("*").alias("sources"), F.sum("b").alias("bytes"), F.min("lo").alias("first_us"), F.max("hi").alias("last_us")).where(F.col("flows") >= floor)


def file_rollup(files: DataFrame, samples: int = 5) -> DataFrame:
    """Paths with digits starred: count, first, last and the first few distinct paths by name.

    Samples come from the distinct paths by rank, so no group's paths are collected whole.
    """
    d = files.withColumn("pattern", F.regexp_replace("path", r"\d+", "*"))
    per = d.groupBy("pattern", "action", "path").agg(F.count("*").alias("n"), F.min("time_us").alias("lo"), F.max("time_us").alias("hi"))
    tot = per.groupBy("pattern", "action").agg(F.sum("n").alias("events"), F.min("lo").alias("first_us"), F.max("hi").alias("last_us"))
    # "rank <= n" is applied before the shuffle as well, so a busy pattern sends n rows per task
    w = Window.partitionBy("pattern", "action").orderBy("path")
    few = per.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= samples)
    few = few.groupBy("pattern", "action").agg(F.array_sort(F.collect_list("path")).alias("samples"))
    return tot.join(few, ["pattern", "action"])


def state_changes(flows: DataFrame, keys: list[str], slice_us: int = 3600 * tl.SECOND) -> DataFrame:
    """Rows at which a connection's state differs from its previous row, with bytes so far.

    The previous state at a slice start comes from the last state of the slice before.
    """
    run = tl.running_sum(flows, keys, ["flow_id"], "time_us", {"bytes_so_far": F.col("bytes_in") + F.col("bytes_out")}, slice_us)
    run = run.withColumn(tl.SLICE, tl.slice_of(F.col("time_us"), slice_us)).withColumn(tl.KEY, tl.key_column(keys))
    last = run.groupBy(tl.KEY, tl.SLICE).agg(F.max_by("state", F.struct("time_us", "flow_id")).alias("_ls"))
    carried = last.select(tl.KEY, tl.SLICE, F.lag("_ls").over(Window.partitionBy(tl.KEY).orderBy(tl.SLICE)).alias("_carry"))
    w = Window.partitionBy(tl.KEY, tl.SLICE).orderBy("time_us", "flow_id")
    out = run.withColumn("_prev", F.lag("state").over(w)).join(carried, [tl.KEY, tl.SLICE])
    out = out.withColumn("previous", F.coalesce("_prev", "_carry"))
    return out.where(F.col("previous").isNull() | (F.col("previous") != F.col("state"))).drop(tl.KEY, tl.SLICE, "_prev", "_carry")


def sampled(id_col: str, per_mille: Column) -> Column:
    """Deterministic thinning: keep a row when the hash of its id falls under the rate."""
    return F.pmod(F.xxhash64(id_col), F.lit(1000)) < per_mille


def adaptive_sample(ev: DataFrame, keys: list[str], id_col: str = "id", slice_us: int = 3600 * tl.SECOND) -> DataFrame:
    """Rate by how many rows of the key came before: all of the first 100, then 1/2, 1/10, 1/100."""
    run = tl.running_sum(ev, keys, [id_col], "time_us", {"nth": F.lit(1).cast("long")}, slice_us)
    n = F.col("nth")
    rate = F.when(n <= 100, 1000).when(n <= 1000, 500).when(n <= 10000, 100).otherwise(10)
    return run.withColumn("rate", rate).where(sampled(id_col, F.col("rate")))


def stratified_sample(ev: DataFrame, priority: str, id_col: str = "id") -> DataFrame:
    """All of P0 and P1, half of P2, a tenth of P3."""
    rate = F.when(F.col(priority) <= 1, 1000).when(F.col(priority) == 2, 500).otherwise(100)
    return ev.withColumn("rate", rate).where(sampled(id_col, F.col("rate")))


def sequence_chain(det: DataFrame, entity: str, steps: list[str], window_us: int, column: str = "technique_id") -> DataFrame:
    """Entities that show the steps in order within the window of the first one.

    The latest start that has reached each step is carried forward: a start is the time of the
    first step, step i takes over the best start among earlier rows of step i-1. That is one
    running maximum per step over (entity, slice) with the window as reach, and no pairs.
    """
    hit = det.where(F.col(column).isin(*steps)).select(entity, "time_us", F.col(column).alias("_s"))
    hit = hit.groupBy(entity, "time_us", "_s").agg(F.count("*").alias("_n"))
    s = tl.sliding(hit, "time_us", window_us)
    before = Window.partitionBy(entity, tl.SLICE).orderBy("time_us").rangeBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_b0", F.when(F.col("_s") == steps[0], F.col("time_us")))
    for i in range(1, len(steps)):
        best = F.max(f"_b{i - 1}").over(before)
        s = s.withColumn(f"_b{i}", F.when((F.col("_s") == steps[i]) & (F.col("time_us") - best <= window_us), best))
    end = f"_b{len(steps) - 1}"
    return s.where(F.col("_own") & F.col(end).isNotNull()).select(entity, F.col(end).alias("start_us"), F.col("time_us").alias("end_us"))


def threshold_rule(ev: DataFrame, keys: list[str], window_us: int, floor: int) -> DataFrame:
    """Instants at which a key has at least ``floor`` events in (t - window, t]."""
    per = ev.groupBy(*keys, "time_us").agg(F.count("*").alias("_n"))
    s = tl.sliding(per, "time_us", window_us - 1)
    n = F.sum("_n").over(tl.sliding_window(keys, "time_us", window_us - 1))
    return s.withColumn("events", n).where(F.col("_own") & (F.col("events") >= floor)).select(*keys, "time_us", "events")


def value_count_rule(ev: DataFrame, keys: list[str], value: str, window_us: int, floor: int) -> DataFrame:
    """Instants at which a key has at least ``floor`` distinct values in (t - window, t]."""
    from wardlake.operators.flows import port_scan

    packed = ev.where(F.col(value).isNotNull()).select(F.col(keys[0]).alias("src_ip"), (F.concat_ws("\x01", *keys[1:]) if keys[1:] else F.lit("")).alias("dst_ip"), F.col(value).alias("dst_port"), "time_us")
    out = port_scan(packed, floor, window_us)
    rest = F.split("dst_ip", "\x01")
    return out.select(F.col("src_ip").alias(keys[0]), *[F.get(rest, F.lit(i)).alias(k) for i, k in enumerate(keys[1:])], "time_us", F.col("ports").alias("values"))


def baseline_zscore(counts: DataFrame, keys: list[str], bucket: str, value: str, reach: int, sigmas: float = 3.0) -> DataFrame:
    """Buckets whose value exceeds mean + sigmas * deviation of the ``reach`` buckets before.

    ``counts`` holds one row per (key, bucket), so the frame is bounded by ``reach``.
    """
    s = tl.sliding(counts, bucket, reach, 4 * reach)
    w = Window.partitionBy(*keys, tl.SLICE).orderBy(bucket).rangeBetween(-reach, -1)
    s = s.withColumns({"mean": F.avg(value).over(w), "sd": F.stddev_pop(value).over(w), "_k": F.count(value).over(w)}).where("_own AND _k > 1 AND sd > 0")
    return s.where(F.col(value) > F.col("mean") + sigmas * F.col("sd")).select(*keys, bucket, value, "mean", "sd")


def monitor_conn(flows: DataFrame, suspicious=(4444, 5555, 6666, 8888, 1337, 31337)) -> DataFrame:
    """Connections worth keeping: public destination, suspicious port, or a service port."""
    from wardlake.functions.net import is_private

    return flows.where(~is_private(F.col("dst_ip")) | F.col("dst_port").isin(*suspicious) | (F.col("dst_port") < 1024))


def top_targets(hits: DataFrame, per_rule: int = 10, buckets: int = 50) -> DataFrame:
    """Targets per rule by matches: address for network classes, host otherwise; 'internal' when none is known."""
    target = F.when(F.col("class_uid").between(4001, 4003), F.col("dst_ip")).otherwise(F.col("hostname"))
    counts = hits.withColumn("target", target).groupBy("rule_id", "target").agg(F.count("*").alias("n"))
    known = counts.where("target IS NOT NULL")
    w = Window.partitionBy("rule_id").orderBy(F.desc("n"), "target")
    top = known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(per_rule, buckets))
    none = counts.groupBy("rule_id").agg(F.sum("n").alias("n"), F.count("target").alias("_k")).where("_k = 0").select("rule_id", F.lit("internal").alias("target"), "n", F.lit(1).alias("rank"))
    return top.unionByName(none)
