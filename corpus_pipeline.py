"""A training-text pipeline over ``documents``: five stages, each applying one operator to what the stage before kept.

Every stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and returns a DataFrame
of the same columns; the last returns the encoded documents. run() writes each stage's result as Parquet to the
shared checkpoint folder and rereads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import bpe, decontam, linededup, simhash, toxicity
from wardlake.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go; the rows of the others stay as they are."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay only in the last of them; every document stays, n_chars follows the text."""
    out = linededup.dedup_lines(docs.select(COLUMNS))
    return out.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles the one with the smallest doc_id stays."""
    scratch = Scratch(spark)
    groups = simhash.similar_groups(docs, scratch=scratch)
    copies = scratch.keep(groups.where(F.col("doc_id") != F.col("group")).select("doc_id"))
    return docs.join(copies, "doc_id", "left_anti").select(COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window similar to a benchmark item (0.8 or more) go."""
    out = decontam.contamination(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.where(F.size("hits") == 0).select("doc_id", "text", "rest.lang", "rest.source", "rest.n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, as op2 returns them."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

ORACLE_SQL = None  # a kernel machine and a tokenizer are beyond SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch.path()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
