"""Merkle manifest of a dataset, built level by level with lag and lead windows.

Every row is a leaf. The leaves of a source, in order of their ids, form a tree in which each run of FANOUT
nodes has one parent; the roots of the sources, in order of the sources, form a tree on top. At each level a
node sees the others of its run as lag and lead columns at offsets 1 and 2, masked by its slot in the run and
the length of the run; the first of a run hashes the parent. The paths then come down the same levels by
equality joins, so each leaf ends with the siblings that lead it to the root.

A source may hold most of the rows: positions come from range partitions and their counts, and windows span
BLOCK neighbouring positions (a multiple of FANOUT), never a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import Scratch

FANOUT = 3
BLOCK = FANOUT**8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


def digest(parts: Column) -> Column:
    return F.sha2(parts.cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields one after another: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    framed = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return digest(F.concat(*framed))


def positions(rows: DataFrame, group: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """rows with pos (from 0, in the order given) and n (the number of rows) within each group.

    Rows are dealt out by ranges of group and order, so that a large group lies in many partitions; a row's
    position is the number of rows of its group in earlier partitions plus its place in its own. Rows equal in
    all order columns take their places in any order.
    """
    dealt = scratch.keep(rows.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()), from_scan=True)
    counts = dealt.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(*group)
    counts = counts.withColumn("before", F.sum("rows").over(whole.orderBy("part")) - F.col("rows")).withColumn("n", F.sum("rows").over(whole))
    counts = scratch.keep(counts.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("part").alias("part_"), "before", "n"))
    same = F.col("part") == F.col("part_")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    place = F.row_number().over(Window.partitionBy(*group, "part").orderBy(*order)) - 1
    return dealt.withColumn("place", place).join(counts, same).select(*rows.columns, (F.col("before") + F.col("place")).alias("pos"), "n")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes(tree, pos, n, hash, ...) -> with left and right (the digests of the run's others, in order) and parent (on a run's first node, else null)."""
    near = Window.partitionBy("tree", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    slot = F.pmod("pos", F.lit(FANOUT))
    run = F.least(F.lit(FANOUT).cast("long"), F.col("n") - F.col("pos") + slot)
    before = [F.when(slot >= k, F.lag("hash", k).over(near)).otherwise("") for k in range(FANOUT - 1, 0, -1)]
    after = [F.when(slot + k < run, F.lead("hash", k).over(near)).otherwise("") for k in range(1, FANOUT)]
    seen = nodes.withColumns({"left": F.concat(*before), "right": F.concat(*after)})
    return seen.withColumn("parent", F.when((slot == 0) & (F.col("n") > 1), digest(F.concat("hash", "right"))))


def levels(leaves: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """leaves(tree, pos, n, hash, ...) -> the levels (tree, pos, n, hash, left, right, parent, ...) from the leaves up; a tree ends at the level where it has one node."""
    out = [scratch.keep(with_siblings(leaves))]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        above = out[-1].where("parent is not null").select(
            "tree", F.floor(F.col("pos") / FANOUT).alias("pos"), F.floor((F.col("n") + FANOUT - 1) / FANOUT).alias("n"), F.col("parent").alias("hash"))
        out.append(scratch.keep(with_siblings(above)))
    return out


def roots(tree_levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of each tree's last node."""
    out = None
    for level in tree_levels:
        top = level.where("n = 1").select("tree", "hash")
        out = top if out is None else out.unionAll(top)
    return out


def paths(tree_levels: list[DataFrame], from_root: DataFrame, scratch: Scratch) -> DataFrame:
    """from_root(tree, path, *more) -> the leaf level with path (the siblings from the leaf's own up to the end of from_root's path) and *more."""
    above = None
    more = [c for c in from_root.columns if c not in ("tree", "path")]
    for level in reversed(tree_levels):
        ends = level.where("n = 1").join(from_root, "tree")
        if above is not None:
            step = F.concat(F.array(F.struct("left", "right")), F.col("path"))
            below = level.where("n > 1").withColumn("up", F.floor(F.col("pos") / FANOUT)).join(above, ["tree", "up"]).withColumn("path", step).drop("up")
            ends = ends.unionByName(below)
        if level is tree_levels[0]:
            return ends
        above = scratch.keep(ends.select("tree", F.col("pos").alias("up"), "path", *more))
    raise ValueError("a tree has one level at least")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's hash leads to along a path."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def manifest(docs: DataFrame, tampered_text: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """documents -> doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified; one row per row.

    tampered_text is the text that is checked against the manifest, row by row (default: the row's own text, so
    that all rows verify): folded_root is what it leads to with the original siblings, verified whether that
    is the root. proof_sha256 is the hash of all siblings, level by level. Any column may be null: a null field
    is hashed as ``-``, a null source is a source of its own, before the others, and null ids come first in
    their source. Rows with the same source and id are ordered by their leaves; repeated rows are leaves of
    their own. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    fields = [docs[c] for c in FIELDS[:-1]]
    tampered = docs["text"] if tampered_text is None else tampered_text
    leaves = scratch.keep(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
        leaf_hash([*fields, docs["text"]]).alias("hash"), leaf_hash([*fields, tampered]).alias("tampered")), from_scan=True)
    sources = positions(leaves.select("source").distinct().withColumn("all", F.lit(0)), ["all"], ["source"], scratch)
    sources = scratch.keep(sources.select(F.col("source").alias("name"), F.col("pos").alias("tree")))
    placed = positions(leaves, ["source"], ["doc_id", "hash", "tampered"], scratch)
    placed = placed.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    below = levels(placed, scratch)
    subroots = scratch.keep(roots(below).withColumnRenamed("tree", "pos"))
    top = levels(subroots.select(F.lit(0).cast("long").alias("tree"), "pos", F.lit(subroots.count()).cast("long").alias("n"), "hash"), scratch)
    root = roots(top).first()
    if root is None:
        return leaves.select("doc_id", "source", F.col("hash").alias("leaf"), *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")], F.lit(None).cast("boolean").alias("verified"))
    start = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.array().cast(PATH).alias("path"))
    upper = scratch.keep(paths(top, start, scratch).select(F.col("pos").alias("tree"), F.col("hash").alias("subroot"), "path"))
    out = paths(below, upper, scratch)
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.select("doc_id", "source", F.col("hash").alias("leaf"), "subroot", F.lit(root["hash"]).alias("root"), digest(proof).alias("proof_sha256"), fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
