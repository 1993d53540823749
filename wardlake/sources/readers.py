"""Opening sources as batch or stream DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.schema import EVENT
from wardlake.sources import documents, lines


def _text(spark: SparkSession, path: str, stream: bool) -> DataFrame:
    return (spark.readStream if stream else spark.read).format("text").load(path)


def read_zeek(spark: SparkSession, path: str, log_type: str, stream: bool = False) -> DataFrame:
    text = _text(spark, path, stream).withColumn("_path", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1))
    return lines.parse_zeek(text, log_type)


def read_syslog(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return lines.parse_syslog(_text(spark, path, stream))


def read_authlog(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return lines.parse_authlog(_text(spark, path, stream))


def read_documents(spark: SparkSession, path: str, source: str, checkpoint: str | None = None, stream: bool = False) -> DataFrame:
    """Exported findings of a sensor, one JSON document per line."""
    df = (spark.readStream if stream else spark.read).schema(documents.SCHEMAS[source]).json(path)
    return documents.since(df, source, checkpoint)


def read_stix(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Bundle files; a bundle is one document however many lines it has."""
    return documents.parse_stix(spark.read.option("wholetext", True).text(path), feed)


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Batches already in the event schema."""
    schema = ", ".join(f"`{n}` {t}" for n, t in EVENT.items())
    return (spark.readStream if stream else spark.read).schema(schema).json(path)


def read_bus(spark: SparkSession, servers: str, topic: str, schema: str, max_per_trigger: int | None = None) -> DataFrame:
    """A topic of JSON messages from the earliest offset; the stream checkpoint is the acknowledgement."""
    src = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    if max_per_trigger:
        src = src.option("maxOffsetsPerTrigger", max_per_trigger)
    return from_bus(src.load(), schema)


def from_bus(messages: DataFrame, schema: str) -> DataFrame:
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def to_bus(df: DataFrame, key: str | None = None) -> DataFrame:
    """Messages for a topic: JSON value and optional key."""
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def scan_events(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """The flat event table, pruned to its date partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("date").between(F.lit(start), F.lit(end))) if start is not None else df
