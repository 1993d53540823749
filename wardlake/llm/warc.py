"""Fixity audit of WARC replicas with Merkle trees over ordered offset ranges.

A record's hash is SHA-256 over its bytes. A file is cut into ranges of RANGE bytes; the hash of a range
covers the offsets, lengths and hashes of the records that begin in it, in order, and each node above
covers FANOUT nodes below it, over all files up to one root. Two replicas are compared from the root
down: only below nodes that differ are children looked at, until the damaged records are known. A record
that is lost or changed in place leaves all other ranges as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wardlake.llm.common import Scratch

RANGE_BITS = 16  # ranges of 64 KiB
FANOUT_BITS = 4
FILE_BITS = 34  # files of at most 16 GiB
RECORDS_PER_FILE = 512


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A response record: header block, payload and the two line ends that close it. Nulls count as empty."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    name = F.md5(F.concat_ws("|", page_id.cast("string"), url).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def lay_out(records: DataFrame, *order: str) -> DataFrame:
    """records(file, length, ...) -> with the offset of each record in its file, in the given order; payloads need not be among the columns."""
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def _above(level: DataFrame) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), ",")
    return level.groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(F.sha2(text.cast("binary"), 256).alias("hash"))


def tree(records: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """records(file, offset, length, hash) -> the levels (node, hash), ranges first, up to the root."""
    node = F.shiftleft(F.col("file"), FILE_BITS - RANGE_BITS) + F.shiftright("offset", RANGE_BITS)
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "hash")))
    text = F.array_join(F.transform(inside, lambda r: F.concat_ws(":", r["offset"].cast("string"), r["length"].cast("string"), r["hash"])), ",")
    levels = [scratch.keep(records.groupBy(node.alias("node")).agg(F.sha2(text.cast("binary"), 256).alias("hash")))]
    top = levels[0].agg(F.max("node")).first()[0]
    while top:
        levels.append(scratch.keep(_above(levels[-1])))
        top >>= FANOUT_BITS
    return levels


def differing_ranges(a: list[DataFrame], b: list[DataFrame], scratch: Scratch) -> DataFrame:
    """The ranges (node) whose hashes differ or that only one side has; trees of different height are compared from the lower one's top."""
    differ = None
    for level in range(min(len(a), len(b)) - 1, -1, -1):
        left, right = a[level], b[level]
        if differ is not None:
            parents = differ.withColumnRenamed("node", "parent")
            left, right = (side.join(parents, F.shiftright(side["node"], FANOUT_BITS) == parents["parent"], "left_semi") for side in (left, right))
        right = right.select("node", F.col("hash").alias("other"))
        differ = scratch.keep(left.join(right, "node", "full_outer").where(~F.col("hash").eqNullSafe(F.col("other"))).select("node"))
    return differ


def audit(a: DataFrame, b: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Replicas (file, offset, length, hash) -> file, offset, length, hash, status.

    One row per record of the first replica: ok, corrupt (other bytes or length) or missing (not in the
    second); and one per record that only the second has: extra, with its own length and hash. Records
    are told apart by file and offset; null files or offsets are left out, a null hash counts as empty.
    Repeated records of one offset are compared by their least hash. Empty replicas give no rows, or all
    of the other's.
    """
    scratch = scratch or Scratch(a.sparkSession)
    sides = []
    for side in (a, b):
        rows = side.where("file is not null and offset is not null").select(F.col("file").cast("long").alias("file"), F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), F.coalesce("hash", F.lit("")).alias("hash"))
        least = F.min(F.struct("hash", "length"))
        sides.append(scratch.keep(rows.groupBy("file", "offset").agg(least.alias("r")).select("file", "offset", "r.length", "r.hash")))
    a, b = sides
    node = F.shiftleft(F.col("file"), FILE_BITS - RANGE_BITS) + F.shiftright("offset", RANGE_BITS)
    differ = differing_ranges(tree(a, scratch), tree(b, scratch), scratch)
    suspect = a.withColumn("node", node).join(differ, "node", "left_semi").drop("node")
    other = b.withColumn("node", node).join(differ, "node", "left_semi").select("file", "offset", F.col("length").alias("length_b"), F.col("hash").alias("hash_b"))
    both = suspect.join(other, ["file", "offset"], "full_outer")
    status = (F.when(F.col("hash").isNull(), "extra").when(F.col("hash_b").isNull(), "missing")
              .when((F.col("hash") == F.col("hash_b")) & F.col("length").eqNullSafe(F.col("length_b")), "ok").otherwise("corrupt"))
    looked_at = both.select("file", "offset", F.coalesce("length", "length_b").alias("length"), F.coalesce("hash", "hash_b").alias("hash"), status.alias("status"))
    sound = a.withColumn("node", node).join(differ, "node", "left_anti").select("file", "offset", "length", "hash", F.lit("ok").alias("status"))
    return sound.unionAll(looked_at)


def page_replicas(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pages as WARC records in files of RECORDS_PER_FILE pages, and a second replica with known damage.

    In the second, pages with id 7 modulo 50 have their last character overwritten, and those with id 3
    modulo 97 are lost. A null id goes to file 0.
    """
    page_id = F.col("page_id").cast("long")
    intact = record_text(page_id, F.col("url"), F.col("html"))
    hurt = F.when((F.pmod(page_id, F.lit(50)) == 7) & (F.length("html") > 0), F.concat(F.expr("left(html, length(html) - 1)"), F.lit("~"))).otherwise(F.col("html"))
    damaged = record_text(page_id, F.col("url"), hurt)
    rows = pages.select(
        page_id.alias("page_id"), F.coalesce(F.floor(page_id / RECORDS_PER_FILE), F.lit(0)).cast("long").alias("file"), F.octet_length(intact).cast("long").alias("length"),
        F.sha2(intact.cast("binary"), 256).alias("hash"), F.octet_length(damaged).cast("long").alias("length_b"), F.sha2(damaged.cast("binary"), 256).alias("hash_b"))
    placed = scratch.keep(lay_out(rows, "page_id", "hash"))
    second = placed.where(~F.coalesce(F.pmod("page_id", F.lit(97)) == 3, F.lit(False))).select("file", "offset", F.col("length_b").alias("length"), F.col("hash_b").alias("hash"))
    return placed.select("page_id", "file", "offset", "length", "hash"), second
