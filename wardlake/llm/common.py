"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import checkpoint_dir

ASCII_SPACE = b" \t\n\r\x0b\x0c"


BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bound what goes to Python at once by size as well as by rows; the JVM keeps several such batches outside its heap."""
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text); the text as its UTF-8 bytes, so that Python takes it without decoding. Null texts stay null."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


class Scratch:
    """Tables of one run, written to the shared checkpoint folder and read back: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = bound_batches(spark)
        self.base = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def path(self) -> str:
        return f"{self.base}/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, from_scan: bool = False) -> DataFrame:
        """Write and read back. What comes from shuffles is written as one file per core of the cluster, rather than one per
        shuffle partition; what comes straight from a scan of the input keeps the scan's tasks."""
        path = self.path()
        (df if from_scan else df.coalesce(self.spark.sparkContext.defaultParallelism)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that no later step reads."""
        path = self.paths.pop(id(df), None)
        if path is not None:
            self.delete(path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], gather: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that handles each batch by itself, or batches put together to about so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, gather):
            out = fn(batch)
            if out is not None:
                yield out

    return run


def _gathered(batches: Iterator[pa.RecordBatch], gather: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if held and size >= gather:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and xor-shift steps of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
