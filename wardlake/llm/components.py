"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import Scratch


def _settled_join(rows: DataFrame, lows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows(a, b) with low(a); lows is written first so that a hub's rows can be dealt to several tasks by the skew join."""
    kept = scratch.keep(lows)
    return rows.join(kept, "a"), kept


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b) of longs -> (node, component): the smallest node reachable, for every node that has an edge.

    Null ends and self-loops are ignored, repeated edges count once, no edges give no rows. Each round
    halves the depth of the trees at least, so the number of rounds grows with the logarithm of the
    longest chain; every round is written to the shared folder.
    """
    edges = scratch.keep(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        joined, kept_large = _settled_join(both, lows, scratch)
        large = joined.where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = scratch.keep(large)
        scratch.drop(kept_large)
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        joined, kept_small = _settled_join(large, lows, scratch)
        small = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(kept_small.select("a", F.col("low").alias("b"))).distinct()
        following = scratch.keep(small)
        for old in (edges, large, kept_small):
            scratch.drop(old)
        edges = following
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
