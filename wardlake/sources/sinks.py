"""Writing events, alerts and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.schema import flatten


def write_events(ev: DataFrame, path: str, mode: str = "append") -> None:
    """Flat events partitioned by date, rows of a date sorted by time for tight file statistics."""
    flat = flatten(ev).withColumn("date", F.to_date("time"))
    # a date is spread over many files by a hash salt, so a busy day is no single task
    flat.repartition("date", F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions("date", "time").write.mode(mode).partitionBy("date").parquet(path)


def write_partitioned(df: DataFrame, path: str, time: str = "time", monthly: bool = False, mode: str = "append") -> None:
    name = F.date_format(time, "yyyy.MM" if monthly else "yyyy.MM.dd")
    df.withColumn("part", name).write.mode(mode).partitionBy("part").parquet(path)


def write_alerts_jsonl(alerts: DataFrame, path: str, max_per_file: int = 100_000, mode: str = "append") -> None:
    alerts.write.mode(mode).option("maxRecordsPerFile", max_per_file).json(path)


def write_csv_page(df: DataFrame, path: str, columns: list[str], limit: int | None = None) -> None:
    """Rows as a CSV export, newest first, NULL as ''; all of them unless a limit is asked for."""
    page = df.orderBy(F.desc("time_us"), F.asc("id"))
    page = page if limit is None else page.limit(limit)
    page.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def publish(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Stream rows to a topic."""
    from wardlake.sources.readers import to_bus

    return to_bus(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
