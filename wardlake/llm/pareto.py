"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most MAX_COPIES times what it has. Its documents
are all taken as often as target / size has whole times; what is left of the target is a sample without
repeats. In it a document of s words has the inclusion odds k * s, k being the same for documents of about
the same length (a class: lengths within GROWTH), so it is ranked by U / (1 - U) / (k * s), U a uniform number
made from its id, and the first of each class are taken: a sample of fixed size with unequal probabilities
for which k need not be known. The sizes of the samples come from the words left of the target, longest class
first, each class making up for the rounding of those before it; so a few very long documents do not carry
the result away from its target.

The first n of a class are found with a histogram of ranks and a sort of the one bin in which the n-th
lies; no class or source is ever sorted in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import Scratch

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
GROWTH = 1.1
BIN_ROWS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    """A number strictly between 0 and 1, the same in every run."""
    return ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)).cast("double") + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """sizes(source, words) -> source, words, target (double), whole (copies all documents get), left (words of the target beyond these).

    The words of all sources are shared out by weight; a source gets at most max_copies times its own, and
    what others leave is shared again by weight until no source is above. Sources that reach their limit are
    those with the least words for their weight, so one ordering finds them all, in exact integers.
    """
    everything = Window.orderBy(F.lit(0))
    in_order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_ratio = Window.orderBy(F.col("words") / F.col("w"), "words", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (in_order % len(weights) + 1).cast("int"))
    wide = "decimal(38,0)"
    rows = sizes.withColumn("w", w)
    rows = rows.withColumns({"all_words": F.sum("words").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "all_w": F.sum("w").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    cap = F.col("words") * max_copies
    rows = rows.withColumns({
        "words_left": F.col("all_words") - F.coalesce(F.sum(cap).over(by_ratio), F.lit(0)),
        "w_left": F.col("all_w") - F.coalesce(F.sum("w").over(by_ratio), F.lit(0))})
    full = cap.cast(wide) * F.col("w_left").cast("decimal(19,0)") < F.col("words_left").cast(wide) * F.col("w").cast("decimal(19,0)")
    rows = rows.withColumn("full", full)
    level = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "share_words": F.col("all_words") - F.coalesce(F.sum(F.when(F.col("full"), cap)).over(level), F.lit(0)),
        "share_w": F.col("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(level), F.lit(0))})
    due = F.col("share_words").cast("decimal(19,0)") * F.col("w").cast("decimal(10,0)")
    parts = F.col("share_w").cast("decimal(10,0)")
    target = F.when(F.col("full"), cap.cast("double")).otherwise(F.col("share_words").cast("double") * F.col("w") / F.col("share_w"))
    whole = F.when(F.col("words") == 0, F.lit(0)).when(F.col("full"), F.lit(max_copies)).otherwise(F.call_function("div", due, parts * F.col("words").cast("decimal(19,0)"))).cast("long")
    return rows.select("source", "words", target.alias("target"), whole.alias("whole"), F.greatest(target - whole * F.col("words"), F.lit(0.0)).alias("left"))


def allot(classes: pd.DataFrame, seed: int) -> list[int]:
    """How many documents to take of each class of one source: classes(class, rows, words, left), longest first.

    A class gets the words that are due so far less those given so far, in documents of its mean length; a
    fraction is rounded up or down at random where the shorter classes can make up for either, else so that
    they can, or to the nearer. The result does not depend on anything but the classes and the seed.
    """
    left, out = float(classes["left"].iloc[0]), []
    total = float(classes["words"].sum())
    part, due, given, after = min(1.0, left / total), 0.0, 0.0, total
    for cls, rows, words in zip(classes["class"], classes["rows"], classes["words"]):
        due += part * words
        after -= words
        mean = words / rows
        exact = min(max((due - given) / mean, 0.0), float(rows))
        choices = {math.floor(exact), min(math.ceil(exact), int(rows))}
        sound = sorted(n for n in choices if 0 <= left - given - n * mean <= after)
        if len(sound) == 2:
            u = ((cls * 2654435761 + seed * 40503 + int(rows)) % 1000003 + 0.5) / 1000003
            n = sound[1] if u < exact - sound[0] else sound[0]
        else:
            n = sound[0] if sound else min(choices, key=lambda n: (abs(left - given - n * mean), n))
        out.append(n)
        given += n * mean
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 42, bin_rows: int = BIN_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """documents -> doc_id, source, size, source_size, target, copies, taken; one row per row.

    size counts the words of the text, taken is copies * size; copies is 0 to max_copies, the whole copies of
    the source plus one if the sample takes the document. A null text has no words; documents without words
    get the whole copies of their source and are not sampled. Null sources form one source, after all others.
    A source without words has the target 0. Null ids and repeated rows are documents like any other: rows
    with the same id, source and size are alike, and which of them is taken makes no difference to the result.
    Other columns are not read. An empty table gives no rows. The same rows and seed give the same result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size")), from_scan=True)
    plan = scratch.keep(targets(rows.groupBy("source").agg(F.sum("size").alias("words")), weights, max_copies))
    plan = plan.select(F.col("source").alias("name"), F.col("words").alias("source_size"), "target", "whole", "left")

    cls = F.when(F.col("size") > 0, F.floor(F.log("size") / math.log(GROWTH)))
    rows = rows.withColumn("class", cls)
    classes = rows.where("size > 0").groupBy("source", "class").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    classes = classes.join(plan.select("name", "left"), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("class", ascending=False)
        return group.assign(take=allot(group, seed))[["source", "class", "rows", "words", "take"]]

    chosen = classes.groupBy("source").applyInPandas(choose, "source string, class long, rows long, words long, take long")
    chosen = scratch.keep(chosen.select(F.col("source").alias("s"), F.col("class").alias("c"), "rows", "words", "take"))

    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))
    u = uniform(seed, F.col("doc_id"), F.col("source"), F.col("size"))
    rank = u / (1 - u) / (F.col("size") / (F.col("words") / F.col("rows")))
    bins = F.ceil(F.col("rows") / bin_rows)
    # rank / (1 + rank) is about uniform in a class, so the bins are about equally full
    ranked = rows.where("size > 0").join(chosen, same).withColumn("rank", rank).withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * bins), bins - 1))
    of_class = Window.partitionBy("s", "c")
    full_bins = ranked.groupBy("s", "c", "bin", "take").agg(F.count(F.lit(1)).alias("n"))
    full_bins = full_bins.withColumn("before", F.sum("n").over(of_class.orderBy("bin")) - F.col("n"))
    edge = full_bins.where((F.col("before") < F.col("take")) & (F.col("take") <= F.col("before") + F.col("n")))
    edge = edge.select("s", "c", F.col("bin").alias("edge"), (F.col("take") - F.col("before")).alias("need"))
    edge = scratch.keep(chosen.select("s", "c", "rows", "words", "take").join(edge.select(F.col("s").alias("s2"), F.col("c").alias("c2"), "edge", "need"), F.col("s").eqNullSafe(F.col("s2")) & (F.col("c") == F.col("c2")), "left").drop("s2", "c2"))

    placed = rows.join(edge, same, "left").withColumn("rank", rank).withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * bins), bins - 1))
    in_edge = F.coalesce(F.col("bin") == F.col("edge"), F.lit(False))
    sure = placed.where(~in_edge).select("doc_id", "source", "size", F.coalesce(F.col("bin") < F.col("edge"), F.lit(False)).alias("sampled"))
    place = F.row_number().over(of_class.orderBy("rank", "doc_id"))
    last = placed.where(in_edge).withColumn("place", place).select("doc_id", "source", "size", (F.col("place") <= F.col("need")).alias("sampled"))
    out = sure.unionAll(last).join(plan, F.col("source").eqNullSafe(F.col("name")))
    copies = F.col("whole") + F.col("sampled").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
