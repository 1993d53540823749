"""Embedding near-duplicates through iteratively quantised binary codes and multi-index Hamming tables.

A rotation of the principal axes is learned so that its signs lose little (iterative quantisation); the
signs are a vector's code. Codes are cut into 16-bit pieces, one table each; a pair whose codes differ by
at most 2 * tables - 1 bits differs by at most one bit in some piece, so probing each table with a piece
and its 16 neighbours finds it. Candidates are compared by their original vectors in double precision.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import Scratch, by_batch, longs
from wardlake.llm.components import components

PIECE = 16
TABLES = 4  # at most 64 bits of code
FIT_SAMPLE = 20_000  # vectors the rotation is fitted on: those with the smallest hash of their id
ROUNDS = 30


class Rotation(NamedTuple):
    centre: np.ndarray
    axes: np.ndarray  # dimensions x bits


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit(vectors: np.ndarray, seed: int = 7) -> Rotation:
    """Principal axes, then the rotation that brings the projections closest to their signs."""
    x = unit(vectors.astype(float))
    centre = x.mean(0)
    x = x - centre
    bits = min(x.shape[1], PIECE * TABLES)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return Rotation(centre, axes @ r)


def rotations(vectors: DataFrame) -> dict[int, Rotation]:
    """One rotation per number of dimensions met in the sample."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_SAMPLE).toPandas()["embedding"]
    by_size: dict[int, list] = {}
    for v in rows:
        by_size.setdefault(len(v), []).append(v)
    return {n: fit(np.stack(vs)) for n, vs in by_size.items()}


def codes(vectors: np.ndarray, models: dict[int, Rotation]) -> np.ndarray:
    """The signs as bits of an unsigned number; a number of dimensions that the sample lacks gets random axes."""
    n = vectors.shape[1]
    model = models.get(n)
    if model is None:
        axes = np.linalg.qr(np.random.default_rng(n).normal(size=(n, n)))[0][:, : PIECE * TABLES]
        model = Rotation(np.zeros(n), axes)
    bits = (unit(vectors) - model.centre) @ model.axes >= 0
    packed = np.zeros((len(vectors), PIECE * TABLES), bool)
    packed[:, : bits.shape[1]] = bits
    return np.packbits(packed, axis=1, bitorder="little").view(np.uint64).ravel()


def usable(embedding) -> F.Column:
    """No null vector, null or non-finite component, and not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(embedding, lambda x: x != 0), F.lit(False))


def _coded(classes: DataFrame, models) -> DataFrame:
    def run(batch):
        out = np.zeros(batch.num_rows, np.uint64)
        column = batch["embedding"]
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        starts = sizes.cumsum() - sizes
        for n in np.unique(sizes):
            mine = np.flatnonzero(sizes == n)
            out[mine] = codes(flat[starts[mine][:, None] + np.arange(n)], models.value)
        return pa.record_batch([batch["node"], batch["label"], longs(sizes), longs(out.view(np.int64))], ["node", "label", "size", "code"])

    return classes.select("node", "label", "embedding").mapInArrow(by_batch(run), "node long, label long, size long, code long")


def _piece(code: str, t: int) -> F.Column:
    return F.shiftrightunsigned(F.col(code), PIECE * t).bitwiseAND((1 << PIECE) - 1)


def candidates(coded: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, whose codes meet in some table; each pair once, from the first table in which they do."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(PIECE)])
    pieces = F.array(*[_piece("code", t) for t in range(TABLES)])
    index = coded.select(F.col("node").alias("b"), F.col("code").alias("code_b"), "label", "size", F.posexplode(pieces).alias("t", "p"))
    probe = coded.select(F.col("node").alias("a"), F.col("code").alias("code_a"), F.col("label").alias("l"), F.col("size").alias("s"), F.posexplode(pieces).alias("u", "q"))
    probe = probe.select("a", "code_a", "l", "s", "u", F.explode(F.transform(flips, lambda f: F.col("q").bitwiseXOR(f))).alias("q"))
    differ = F.col("code_a").bitwiseXOR(F.col("code_b"))
    before = F.lit(True)
    for t in range(TABLES - 1):
        piece = F.shiftrightunsigned(differ, PIECE * t).bitwiseAND((1 << PIECE) - 1)
        before = before & ((F.col("t") <= t) | (F.bit_count(piece) > 1))
    same = (F.col("t") == F.col("u")) & (F.col("p") == F.col("q")) & (F.col("label") == F.col("l")) & (F.col("size") == F.col("s"))
    return probe.join(index, same & (F.col("a") < F.col("b")) & before).select("a", "b")


def _cosine(pairs: DataFrame) -> DataFrame:
    def run(batch):
        ends = []
        for c in ("va", "vb"):
            flat = batch[c].flatten().to_numpy(zero_copy_only=False).astype(float)
            sizes = np.diff(batch[c].offsets.to_numpy())
            ends.append((flat, sizes.cumsum() - sizes))
        (x, at), (y, _) = ends
        dot, xx, yy = (np.add.reduceat(p, at) for p in (x * y, x * x, y * y))
        return pa.record_batch([batch["a"], batch["b"], pa.array(dot / (np.sqrt(xx) * np.sqrt(yy)))], ["a", "b", "cosine"])

    return pairs.mapInArrow(by_batch(run), "a long, b long, cosine double")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept; one row per row.

    Vectors link when their labels are equal and not null and their cosine is at least the threshold.
    Null vectors, zero vectors and those with null or non-finite components link with nothing (nor do
    vectors of different size with each other): no links, their own component, kept. Equal vectors of one
    label are one class before any comparison, so copies are never paired; repeated rows link with each
    other as copies do. A null vec_id keeps its row, counts as a vector, names no component and is not
    kept. An empty table gives no rows; other columns are not read.
    """
    scratch = scratch or Scratch(embeddings.sparkSession)
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].alias("embedding"), embeddings["label"].cast("long").alias("label"))
    good = usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = scratch.keep(rows.withColumn("good", good), from_scan=True)
    linked = rows.where("good")
    classes = linked.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))
    models = embeddings.sparkSession.sparkContext.broadcast(rotations(linked))
    coded = scratch.keep(_coded(classes, models))
    pairs = scratch.keep(candidates(coded))
    vectors = classes.select("node", "embedding")
    first = pairs.join(vectors.select(F.col("node").alias("a"), F.col("embedding").alias("va")), "a")
    both = first.join(vectors.select(F.col("node").alias("b"), F.col("embedding").alias("vb")), "b").select("a", "b", "va", "vb")
    links = scratch.keep(_cosine(both).where(F.col("cosine") >= threshold).select("a", "b"))
    sizes = scratch.keep(classes.select("node", "members"))
    ways = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = scratch.keep(ways.join(sizes, ways["b"] == sizes["node"]).groupBy("a").agg(F.sum("members").alias("others")))
    roots = components(links, scratch)
    facts = classes.join(counts, classes["node"] == counts["a"], "left").join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    facts = scratch.keep(facts.select("label", "embedding", "least", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")))
    firsts = scratch.keep(facts.groupBy("root").agg(F.min("least").alias("component_id")))
    facts = scratch.keep(facts.join(firsts, "root").select("label", "embedding", "n_links", "component_id"))
    found = linked.join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
