"""Structured Streaming jobs: normalise, match rules, watch flows, keep alerts unique.

Event time is the only clock. Rows later than the watermark go to a side table; state leaves with
the watermark or its own time to live.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlake import fixed
from wardlake.functions.net import is_private
from wardlake.session import checkpoint_dir
from wardlake.streaming import ordered

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory, and the provider stateful Python processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(df: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Drain what the source has now into a table of the checkpoint folder and return that table."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def append(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch: a batch that is run again after a failure replaces its own rows
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # an empty first folder, so that the table can be read when no row comes out
    spark.createDataFrame([], df.schema).withColumn("_batch", F.lit(-1)).write.mode("overwrite").parquet(f"{out}/batch=-1")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(each or append).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key from an update-mode table."""
    cols = [c for c in table.columns if c != "_batch"]
    return table.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*cols), "_batch").alias("r")).select("r.*")


# ------------------------------------------------------------------------------------- stateless stages


def normalised(raw: DataFrame, normalise: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of a raw stream."""
    from wardlake.operators.normalizers import split_valid

    return split_valid(normalise(raw))


def persist_each_batch(path: str, others: list[Callable[[DataFrame], None]] = ()) -> Callable[[DataFrame, int], None]:
    """Batch writer to the event table and further stores; a store that fails does not stop the rest."""
    def write(batch: DataFrame, batch_id: int) -> None:
        from wardlake.schema import flatten

        kept = batch.persist()
        try:
            for other in others:
                try:
                    other(kept)
                except Exception as e:
                    print(f"store failed in batch {batch_id}: {e}")
            flatten(kept).withColumn("date", F.to_date("time")).write.mode("overwrite").partitionBy("date").parquet(f"{path}/batch={batch_id}")
        finally:
            kept.unpersist()

    return write


def with_reloaded_rules(load: Callable[[], list], handle: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """Re-read the rule table before every batch, so a changed rule takes effect with the next one."""
    from wardlake.operators.alerts import rule_alerts

    def run(batch: DataFrame, batch_id: int) -> None:
        handle(rule_alerts(batch, load()).withColumn("_batch", F.lit(batch_id)))

    return run


def split_late(batch: DataFrame, watermark_us: int) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows the watermark has passed)."""
    late = F.col("time_us") < watermark_us
    return batch.where(~late), batch.where(late)


# ------------------------------------------------------------------------------------- windowed detectors


def first_seen(flows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First private-to-private administration flow per pair and day; state leaves with the day."""
    hit = flows.where(is_private(F.col("src_ip")) & is_private(F.col("dst_ip")) & F.col("dst_port").isin(*fixed.LATERAL_PORTS))
    return hit.withWatermark("time", delay).groupBy("src_ip", "dst_ip", F.window("time", "1 day").alias("w")).agg(F.min("time").alias("time"))


def port_scan(flows: DataFrame, threshold: int = 15, delay: str = "10 minutes", length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding windows with many ports per (src, dst); ports are first made distinct by a sketch."""
    w = flows.withWatermark("time", delay).groupBy("src_ip", "dst_ip", F.window("time", length, slide).alias("w"))
    return w.agg(F.approx_count_distinct("dst_port", 0.02).alias("ports")).where(F.col("ports") >= threshold)


def brute_force(flows: DataFrame, threshold: int = 10, delay: str = "10 minutes", length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    tries = flows.where(F.col("dst_port").isin(*fixed.AUTH_PORTS) & (F.col("duration_ms") <= 2000) & (F.col("bytes_in") <= 1000))
    return tries.withWatermark("time", delay).groupBy("src_ip", "dst_port", F.window("time", length, slide).alias("w")).agg(F.count("*").alias("attempts")).where(F.col("attempts") >= threshold)


def exfil(flows: DataFrame, threshold: int = 100_000_000, delay: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Tumbling windows whose volume per (src, dst, port) passes the threshold."""
    v = F.sum(F.col("bytes_in") + F.col("bytes_out"))
    return flows.withWatermark("time", delay).groupBy("src_ip", "dst_ip", "dst_port", F.window("time", length).alias("w")).agg(v.alias("total_bytes")).where(F.col("total_bytes") >= threshold)


def closed_windows(flows: DataFrame, delay: str, length: str) -> DataFrame:
    """Per-window counts in append mode: a window comes out once, when the watermark passes it and its state goes."""
    return flows.withWatermark("time", delay).groupBy("protocol", F.window("time", length).alias("w")).agg(F.count("*").alias("flows"))


# ------------------------------------------------------------------------------------- exact keyed state


class TtlDedup(StatefulProcessor):
    """Keep a row, then drop the key's rows until the TTL after it.

    State is one number per key; an event-time timer removes it once the watermark has passed the
    end of the TTL.
    """

    def __init__(self, ttl_us: int, columns: list[str]):
        self.ttl_us, self.columns = ttl_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values(["time_us", "id"], kind="stable")
        kept = []
        for i, t in enumerate(batch["time_us"].tolist()):
            if last is None or t - last >= self.ttl_us:
                last = t
                kept.append(i)
        if kept:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(last))
            self.last.update((int(last),))
            yield batch.iloc[kept][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def _end(self, at: int) -> int:
        return (int(at) + self.ttl_us) // 1000 + 1

    def close(self) -> None:
        pass


def dedup_exact(alerts: DataFrame, keys: list[str], ttl_us: int, delay: str = "10 minutes") -> DataFrame:
    """Greedy TTL dedup with keyed state. A micro-batch's rows of one key are ordered in memory; bound
    the batch with the source's rate options."""
    use_rocksdb(alerts.sparkSession)
    cols = [*keys, "id", "time_us"]
    out = alerts.select(*cols).schema
    return alerts.withWatermark("time", delay).select(*cols, "time").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=TtlDedup(ttl_us, cols), outputStructType=out, outputMode="Append", timeMode="EventTime")


class Beacon(StatefulProcessor):
    """Last samples of a flow; fires once when their gaps are regular. State: at most ``max_samples`` times a flow, kept for buckets of flows."""

    KEY = "src_ip string, dst_ip string, dst_port int"

    def __init__(self, gap_us: int, min_samples: int, max_cv: float, max_samples: int):
        self.gap_us, self.min_samples, self.max_cv, self.max_samples = gap_us, min_samples, max_cv, max_samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flows = handle.getListState("flows", f"{self.KEY}, fired boolean, samples array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple, list[int]] = {}
        for frame in rows:
            for *flow, t in ordered.plain_rows(frame, ["src_ip", "dst_ip", "dst_port", "time_us"]):
                fresh.setdefault(tuple(flow), []).append(t)
        state = {tuple(r)[:3]: (r[3], list(r[4])) for r in self.flows.get()}
        out = []
        for flow, times in fresh.items():
            fired, held = state.get(flow, (False, []))
            if not fired:
                hit, held = self._next(sorted(times), held)
                if hit is not None:
                    out.append((*flow, *hit))
                state[flow] = (hit is not None, held)
        kept = [(*flow, *s) for flow, s in state.items()]
        self.flows.put(kept[: ordered.PUT_ROWS])
        for at in range(ordered.PUT_ROWS, len(kept), ordered.PUT_ROWS):
            self.flows.appendList(kept[at : at + ordered.PUT_ROWS])
        if out:
            yield pd.DataFrame(out, columns=["src_ip", "dst_ip", "dst_port", "time_us", "samples"])

    def _next(self, times: list[int], held: list[int]) -> tuple[tuple[int, int] | None, list[int]]:
        """(time and samples of the first regular stretch or None, the samples to keep)."""
        held = deque(held)
        squares = sum((b - a) ** 2 for a, b in pairwise(held))
        for t in times:
            if held and t - held[-1] < self.gap_us:
                continue
            if held:
                squares += (t - held[-1]) ** 2
            held.append(t)
            if len(held) > self.max_samples:
                first = held.popleft()
                squares -= (held[0] - first) ** 2
            if len(held) < self.min_samples:
                continue
            # exact integers rule out nearly all; the others are computed from their gaps
            whole = held[-1] - held[0]
            if (len(held) - 1) * squares - whole * whole > (self.max_cv * whole) ** 2 * (1 + 1e-6):
                continue
            gaps = pd.Series(held).diff().dropna() / 1e6
            if gaps.std(ddof=0) / gaps.mean() <= self.max_cv:
                return (int(t), len(held)), []
        return None, [int(t) for t in held]

    def close(self) -> None:
        pass


def beacon(flows: DataFrame, gap_us: int = 48_000_000, min_samples: int = 5, max_cv: float = 0.20, max_samples: int = 100) -> DataFrame:
    use_rocksdb(flows.sparkSession)
    keys = ["src_ip", "dst_ip", "dst_port"]
    return flows.where(F.col("time_us").isNotNull()).select(*keys, "time_us", ordered.buckets(flows.sparkSession, keys).alias("_bucket")).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=Beacon(gap_us, min_samples, max_cv, max_samples),
        outputStructType=f"{Beacon.KEY}, time_us long, samples long", outputMode="Append", timeMode="None")
