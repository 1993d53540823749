"""Lines repeated across documents, found with levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash, so that it merges with another without a
shuffle. A batch of documents is anti-joined with every run: hashes not met before become a new run at
level 0 (so a hash is in one run only), repeated ones a tally of counts. When a level holds ``fanout``
runs they are compacted into one run of the next level. The counts of a hash are those of its run and of
the tallies together, whatever the batches were.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm.common import ASCII_SPACE, Scratch, by_batch, longs

KEY = ["h1", "h2"]  # 128 bits: two of 10^12 lines share a hash with a chance of 10^-15


def split_lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def key_of(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """The hash of a line's key (white space stripped at both ends, A-Z lower-cased), or None if the key is too short."""
    key = line.strip(ASCII_SPACE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text as binary) -> doc, h1, h2: the keys of each document, each once for a row."""

    def run(batch):
        ids, h = [], []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            keys = {k for k in (key_of(line, min_chars) for line in split_lines(text.as_py())) if k is not None}
            ids += [doc] * len(keys)
            h += keys
        h = np.array(h, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.record_batch([longs(ids), longs(h[:, 0]), longs(h[:, 1])], ["doc", *KEY])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(by_batch(run), "doc long, h1 long, h2 long")


class LineRuns:
    """The runs and tallies of all batches added so far."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 2):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []
        self.tallies: list[DataFrame] = []

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", self.scratch.path()
        df.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
        return name, path

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, batch: DataFrame) -> None:
        """batch(h1, h2, docs, last): each hash once, with the number of documents that hold it and the largest doc_id."""
        batch = self.scratch.keep(batch)
        fresh = batch
        for run in self.runs():
            fresh = fresh.join(run.select(*KEY), KEY, "left_anti")
        new = self._write(fresh)
        self.tallies.append(self.scratch.keep(batch.join(self.spark.table(new[0]).select(*KEY), KEY, "left_anti")))
        self.scratch.drop(batch)
        self.levels = self.levels or [[]]
        self.levels[0].append(new)
        self._compact()

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fanout:
                continue
            merged = None
            for name, _ in runs:
                part = self.spark.table(name)
                merged = part if merged is None else merged.unionAll(part)
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            self._forget(runs)
            self.levels[level] = []

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            self.scratch.delete(path)

    def repeated(self, min_docs: int) -> DataFrame:
        """h1, h2, last of the hashes in at least min_docs documents."""
        tallied = None
        for t in self.tallies:
            tallied = t if tallied is None else tallied.unionAll(t)
        tallied = tallied.groupBy(*KEY).agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        out = None
        for run in self.runs():
            part = run.join(tallied, KEY, "left").where(F.col("docs") + F.coalesce("more", F.lit(0)) >= min_docs).select(*KEY, F.greatest("last", "later").alias("last"))
            out = part if out is None else out.unionAll(part)
        return self.scratch.keep(out)

    def close(self) -> None:
        for level in self.levels:
            self._forget(level)
        for t in self.tallies:
            self.scratch.drop(t)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text, others) -> doc_id, text, n_lines, n_dropped, rest (a struct of the other columns, or null if there are none).

    A key of at least min_chars code points that at least min_docs documents hold loses all its lines
    except those in the largest doc_id that holds it. One row per row. A null or empty text is one empty
    line. Rows with the same doc_id count as one document, each of them losing the same lines. A null
    doc_id is no document: its rows are kept whole and count for nothing. An empty table gives no rows.
    Other columns, whatever their names, are only carried along in ``rest``.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"), (F.struct(*others) if others else F.lit(None).cast("string")).alias("rest"))
    keys = scratch.keep(line_keys(docs, min_chars), from_scan=True)
    runs = LineRuns(spark, scratch, fanout)
    for b in range(batches):
        mine = keys.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b)
        runs.add(mine.groupBy(*KEY).agg(F.countDistinct("doc").alias("docs"), F.max("doc").alias("last")))
    repeated = runs.repeated(min_docs)
    runs.close()
    lost = keys.join(repeated, KEY).where("doc <> last").groupBy("doc").agg(F.collect_set(F.struct(*KEY)).alias("lost"))

    def run(batch):
        texts, n_lines, n_dropped = [], [], []
        for text, gone in zip(batch["text"], batch["lost"].to_pylist()):
            lines = split_lines(text.as_py())
            kept = lines
            if gone:
                gone = {(g["h1"] & 0xFFFFFFFFFFFFFFFF, g["h2"] & 0xFFFFFFFFFFFFFFFF) for g in gone}
                kept = [line for line in lines if key_of(line, min_chars) not in gone]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            texts.append(b"\n".join(kept))
        return pa.record_batch([batch["doc_id"], pa.array(texts, pa.binary()), longs(n_lines), longs(n_dropped), batch["rest"]], ["doc_id", "text", "n_lines", "n_dropped", "rest"])

    joined = docs.join(lost, docs["doc_id"] == lost["doc"], "left").select("doc_id", "text", "lost", "rest")
    rest = docs.schema["rest"].dataType.simpleString() if others else "string"
    out = joined.mapInArrow(by_batch(run), f"doc_id long, text binary, n_lines long, n_dropped long, rest {rest}")
    return out.withColumn("text", F.col("text").cast("string"))
