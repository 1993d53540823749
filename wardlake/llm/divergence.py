"""Divergence of sources within a language: term shares recounted with minimal perfect hashes.

The first pass finds, exactly, the terms that at least min_docs documents of a language hold. They are dealt
to shards of some SHARD_TERMS terms by their hash; a task builds a minimal perfect hash of each shard
(BBHash: levels of bit arrays, a key stays at the first level where it is alone; its slot is the number of
bits set before it) and stores the terms in slot order. The second pass reads the texts again with the
shards broadcast: a distinct term of a batch is looked up, checked against the term stored in its slot, and
its occurrences are added to the dense row of counts of its (language, source) group.

Shards are broadcast in waves of at most WAVE_BYTES, whatever the vocabulary is; each wave is one more pass
over the texts. Shares are compared on tiles of slots and blocks of sources, so no task holds a whole language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import Scratch, longs, mix64

SHARD_TERMS = 1 << 17
WAVE_BYTES = 64 << 20
FLUSH_BYTES = 64 << 20  # dense counts that a task holds before it hands them on
TILE = 1 << 11  # slots of a language compared in one task, of SOURCES x SOURCES sources
SOURCES = 32
GAMMA = 2  # bits a key at each level
SCALE, PRIOR = 1_000_000_000, 5

#: Every ASCII character but the letters becomes a space; A-Z become a-z. Bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def hashes(terms: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))


class PerfectHash(NamedTuple):
    """A minimal perfect hash of one shard's terms, with the terms in slot order."""

    seed: int
    sizes: np.ndarray  # bits of each level
    words: np.ndarray  # the levels' bits, 64 in a word, level after level
    ranks: np.ndarray  # bits set before each word
    terms: pa.Array

    def slots(self, terms: list[bytes]) -> np.ndarray:
        """The slot of each term, -1 for a term that is not of the shard."""
        h = hashes(terms, self.seed)
        out = np.full(len(terms), -1, np.int64)
        left, start = np.arange(len(terms)), 0
        for level, size in enumerate(self.sizes):
            at = _at(h[left], level, size) + np.uint64(start)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            bits = self.words[word]
            hit = (bits >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[word] + below)[hit]
            left, start = left[~hit], start + int(size)
        found = np.flatnonzero(out >= 0)
        stored = self.terms.take(pa.array(out[found]))
        same = pc.equal(stored, pa.array([terms[i] for i in found], pa.binary())).to_numpy(zero_copy_only=False).astype(bool)
        out[found[~same]] = -1
        return out


def _at(h: np.ndarray, level: int, size) -> np.ndarray:
    return mix64(h ^ mix64(np.array([level + 1], np.uint64))) % np.uint64(size)


def perfect_hash(terms: list[bytes]) -> PerfectHash:
    """A perfect hash of distinct terms; if two share a 64-bit hash, another seed is taken."""
    for seed in range(100):
        h = hashes(terms, seed)
        if len(np.unique(h)) == len(h):
            break
    left, placed, sizes, words, start = np.arange(len(terms)), np.zeros(len(terms), np.int64), [], [], 0
    while len(left):
        size = -(-GAMMA * len(left) // 64) * 64
        at = _at(h[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        stays = alone[at]
        placed[left[stays]] = start + at[stays]
        left, start = left[~stays], start + size
        sizes.append(size)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(flat), dtype=np.int64)])[:-1]
    order = np.argsort(placed)
    return PerfectHash(seed, np.array(sizes, np.int64), flat, ranks, pa.array([terms[i] for i in order], pa.binary()))


def read_groups(docs: DataFrame) -> DataFrame:
    """lang, source, text as binary; nulls are empty."""
    lang, source = (F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    return docs.select(lang, source, F.coalesce(docs["text"].cast("binary"), F.lit(b"")).alias("text"))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}
    size = 0

    def rows():
        for lang, found in seen.items():
            yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), longs(list(found.values()))], ["lang", "term", "docs"])

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            found = seen.setdefault(lang, Counter())
            before = len(found)
            found.update(set(terms_of(text.as_py())))
            size += len(found) - before
        if size > 200_000:
            yield from rows()
            seen, size = {}, 0
    yield from rows()


def kept_terms(rows: DataFrame, min_docs: int) -> DataFrame:
    """rows(lang, source, text) -> lang, term (binary) of the terms that at least min_docs rows of the language hold, counted exactly."""
    found = rows.select("lang", "text").mapInArrow(_document_counts, "lang string, term binary, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")


def shard_of(terms: list[bytes], n_shards: int) -> np.ndarray:
    """pmod(xxhash64(term), n_shards), as Spark deals the terms to shards."""
    if n_shards == 1:
        return np.zeros(len(terms), np.int64)
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), np.uint64, len(terms)).view(np.int64) % n_shards


def shards(kept: DataFrame, shard_terms: int, scratch: Scratch) -> DataFrame:
    """kept(lang, term) -> lang, shard, n_shards, first (the number of the shard's first slot in its language), n, built (a pickled perfect hash)."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_terms).alias("n_shards"))
    dealt = kept.join(sizes, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("n_shards")))

    def build(key, group):
        import pickle

        built = perfect_hash(group["term"].to_pylist())
        return pa.table({"lang": [key[0].as_py()], "shard": [key[1].as_py()], "n_shards": [group["n_shards"][0].as_py()], "n": pa.array([group.num_rows], pa.int64()), "built": [pickle.dumps(built, protocol=5)]})

    out = scratch.keep(dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shard long, n_shards long, n long, built binary"))
    first = F.sum("n").over(Window.partitionBy("lang").orderBy("shard")) - F.col("n")
    places = out.select("lang", "shard", first.alias("first"))
    return scratch.keep(out.join(places, ["lang", "shard"]))


def _waves(built: DataFrame, wave_bytes: int) -> Iterator[list]:
    """The shards, some wave_bytes at a time; only their sizes are listed beforehand."""
    sizes = built.select("lang", "shard", F.length("built").alias("bytes")).orderBy("lang", "shard").toLocalIterator()
    wave, held = [], 0
    for row in sizes:
        if wave and held + row["bytes"] > wave_bytes:
            yield wave
            wave, held = [], 0
        wave.append((row["lang"], row["shard"]))
        held += row["bytes"]
    if wave:
        yield wave


def recount(rows: DataFrame, built: DataFrame, wave_bytes: int, flush_bytes: int, scratch: Scratch) -> DataFrame:
    """rows(lang, source, text), built (of shards) -> lang, source, slot (in its language), n: occurrences of the kept terms in each group, none of them zero."""
    spark, parts = rows.sparkSession, []
    for wave in _waves(built, wave_bytes):
        chosen = spark.createDataFrame(wave, "lang string, shard long")
        loaded: dict[str, dict[int, tuple[int, bytes]]] = {}
        counts = {}
        for r in built.join(F.broadcast(chosen), ["lang", "shard"]).collect():  # at most wave_bytes
            loaded.setdefault(r["lang"], {})[r["shard"]] = (r["first"], bytes(r["built"]))
            counts[r["lang"]] = r["n_shards"]
        shared = spark.sparkContext.broadcast((loaded, counts))
        part = rows.where(F.col("lang").isin(list(loaded))).mapInArrow(_slot_counts(shared, flush_bytes), "lang string, source string, slot long, n long")
        parts.append(scratch.keep(part.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))))
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], "lang string, source string, slot long, n long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _slot_counts(shared, flush_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        packed, counts = shared.value
        loaded = {lang: {s: (first, pickle.loads(b)) for s, (first, b) in of.items()} for lang, of in packed.items()}
        dense: dict[tuple[str, str, int], np.ndarray] = {}
        held = 0

        def rows():
            for (lang, source, shard), n in dense.items():
                slots = np.flatnonzero(n)
                yield pa.record_batch([pa.array([lang] * len(slots), pa.string()), pa.array([source] * len(slots), pa.string()), longs(slots + loaded[lang][shard][0]), longs(n[slots])], ["lang", "source", "slot", "n"])

        for batch in batches:
            texts: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
                texts.setdefault((lang, source), []).append(text.as_py())
            for (lang, source), group in texts.items():
                found = Counter(terms_of(b" ".join(group)))
                terms, n = list(found), np.fromiter(found.values(), np.int64, len(found))
                dealt = shard_of(terms, counts[lang])
                for shard, (_, built) in loaded[lang].items():
                    mine = np.flatnonzero(dealt == shard)
                    slots = built.slots([terms[i] for i in mine])
                    kept = slots >= 0
                    key = (lang, source, shard)
                    if key not in dense:
                        dense[key] = np.zeros(len(built.terms), np.int64)
                        held += dense[key].nbytes
                    dense[key][slots[kept]] += n[mine[kept]]  # the terms of a batch are distinct, so are their slots
            if held > flush_bytes:
                yield from rows()
                dense, held = {}, 0
        yield from rows()

    return run


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact for any count."""
    wide = (count.cast("decimal(20,0)") + F.lit(PRIOR)) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + terms * PRIOR).cast("decimal(20,0)"))


def group_table(rows: DataFrame, counts: DataFrame, built: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source, total (occurrences of kept terms), terms (kept in the language), blocks and block (of sources), base (the share of a term that does not occur)."""
    terms = built.groupBy("lang").agg(F.sum("n").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct()
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).alias("blocks"))
    out = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").join(blocks, "lang").na.fill(0, ["total", "terms"])
    base = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    return scratch.keep(out.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))).withColumn("base", base))


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum over all kept terms of the difference of the two shares."""
    entries = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "block", "blocks", F.floor(F.col("slot") / TILE).alias("tile"), F.pmod("slot", F.lit(TILE)).alias("at"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    tiles = F.greatest(F.ceil(F.col("terms") / TILE), F.lit(1))
    heads = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"))
    width = F.least(F.lit(TILE).cast("long"), F.col("terms") - F.col("tile") * TILE)
    heads = heads.select("lang", "source", "block", "blocks", "tile", (-1 - width).alias("at"), F.col("base").alias("p"))
    both = entries.unionAll(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = both.select("lang", "tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "source", "block", "at", "p")
    parts = both.groupBy("lang", "tile", "low", "high").applyInArrow(_compare, "lang string, source string, item string, part long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))


def _compare(key, group):
    """The shares of two blocks of sources on one tile: rows with at >= 0 give a share at a slot, those with at = -1 - width the share of all other slots of the tile."""
    lang, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
    names = group["source"].combine_chunks().dictionary_encode()
    who, at, p = names.indices.to_numpy(zero_copy_only=False), group["at"].to_numpy(), group["p"].to_numpy()
    block = np.zeros(len(names.dictionary), np.int64)
    block[who] = group["block"].to_numpy()
    head = at < 0
    shares = np.zeros((len(block), int(-1 - at[head][0])), np.int64)
    shares[who[head]] = p[head][:, None]
    shares[who[~head], at[~head]] = p[~head]
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    left, right, value = [], [], []
    for i in a:
        far = np.abs(shares[b] - shares[i]).sum(1)
        others = b != i
        left.append(np.full(others.sum(), i))
        right.append(b[others])
        value.append(far[others])
    left, right, value = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right, value))
    if low != high:
        left, right, value = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([value, value])
    source, item = (names.dictionary.take(pa.array(x)) for x in (left, right))
    return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "source": source, "item": item, "part": value})


def _stored_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    for batch in batches:
        for lang, first, packed in zip(batch["lang"].to_pylist(), batch["first"].to_pylist(), batch["built"]):
            terms = pickle.loads(packed.as_py()).terms
            yield pa.record_batch([pa.array([lang] * len(terms), pa.string()), longs(first + np.arange(len(terms))), terms], ["lang", "slot", "term"])


def term_values(counts: DataFrame, groups: DataFrame, built: DataFrame) -> DataFrame:
    """lang, source, item (a kept term that occurs in the group and has a larger share there than in the language), value: the difference of the shares."""
    in_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.first("terms").alias("terms"))
    totals = counts.groupBy("lang", "slot").agg(F.sum("n").alias("lang_n")).join(in_lang, "lang")
    totals = totals.select("lang", "slot", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    named = built.select("lang", "first", "built").mapInArrow(_stored_terms, "lang string, slot long, term binary")
    shares = counts.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).select("lang", "source", "slot", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    found = shares.join(totals, ["lang", "slot"]).where("p > q").join(named, ["lang", "slot"])
    return found.select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def divergence(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, shard_terms: int = SHARD_TERMS, wave_bytes: int = WAVE_BYTES, flush_bytes: int = FLUSH_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """documents -> lang, source, part, item, value, rank: how sources differ from each other and from their language.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those that at
    least min_docs of its rows hold. A group is a (lang, source) that occurs; part ``pair`` has a row for each
    other source of its language, part ``term`` the top_terms terms whose share exceeds the language's most.
    Ranks count from 1, value descending, then item ascending by its bytes. Null text, lang and source are
    empty. Every row is a document of its own, also repeated ones; ids and other columns are not read. A
    language that keeps no term gives pairs of value 0; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = read_groups(docs)
    built = shards(scratch.keep(kept_terms(rows, min_docs)), shard_terms, scratch)
    counts = recount(rows, built, wave_bytes, flush_bytes, scratch)
    groups = group_table(rows, counts, built, scratch)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(counts, groups).withColumn("rank", F.row_number().over(order))
    terms = term_values(counts, groups, built).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
