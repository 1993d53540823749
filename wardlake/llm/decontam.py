"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A window of a document as long as an item (in words) is contaminated by it if the weighted Jaccard
similarity of their 5-word shingles (weight: how often a shingle occurs) reaches the threshold. Windows
and items have SimHash fingerprints; these are cut into 8 blocks of 8 bits, and tables of what lies
within two bits of a block's value give every item within 23 bits of a window, none missed, as a
fingerprint 23 bits away differs by at most two bits in some block. What is found is verified exactly.
A window that shares no shingle with any item has similarity 0, so only windows around shared shingles
get fingerprints.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import by_batch, mix64

K = 5
BLOCKS, BLOCK_BITS, BLOCK_REACH = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_REACH + 1) - 1
ITEM_BYTES = 8 << 20  # of benchmark text broadcast at once; more goes in further passes
FILTER_BITS = 20
KNOWN_WORDS = 60_000

_words = re.compile(r"\w+").findall
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _WordHashes()


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_HASHES) > KNOWN_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit number for each run of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _PRIME + hashes[i : i + n]
    return mix64(out)


def signs(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little")


class Group(NamedTuple):
    """Items of the same number of words."""

    words: int
    k: int
    items: list[int]
    shingles: list[Counter]
    prints: np.ndarray  # items x 8 bytes
    tables: np.ndarray  # [block][value][item]: within reach


class Index(NamedTuple):
    groups: list[Group]
    known: dict[int, tuple[np.ndarray, np.ndarray]]  # by k: a bit table by the leading bits of the hash, and the sorted hashes


def _grams(words: list[str], k: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(k))))


def index(items: list[tuple[int, str | None]]) -> Index:
    """Items without a word match nothing."""
    near = np.array([[int(a ^ b).bit_count() <= BLOCK_REACH for b in range(1 << BLOCK_BITS)] for a in range(1 << BLOCK_BITS)])
    by_size: dict[int, list[tuple[int, list[str]]]] = {}
    for item, text in items:
        words = words_of(text)
        if words:
            by_size.setdefault(len(words), []).append((item, words))
    groups, hashes = [], {}
    for size, members in sorted(by_size.items()):
        k = min(K, size)
        per_item = [shingle_hashes(word_hashes(w), k) for _, w in members]
        prints = np.concatenate([pack(signs(h).sum(0, keepdims=True)) for h in per_item])
        tables = np.stack([near[:, prints[:, b]] for b in range(BLOCKS)])
        groups.append(Group(size, k, [i for i, _ in members], [_grams(w, k) for _, w in members], prints, tables))
        hashes.setdefault(k, []).extend(per_item)
    known = {}
    for k, parts in hashes.items():
        every = np.unique(np.concatenate(parts))
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[every >> np.uint64(64 - FILTER_BITS)] = True
        known[k] = (bits, every)
    return Index(groups, known)


def _shared(shingles: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    bits, every = known
    at = np.flatnonzero(bits[shingles >> np.uint64(64 - FILTER_BITS)])
    return at[every[np.minimum(np.searchsorted(every, shingles[at]), len(every) - 1)] == shingles[at]]


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[g]) for g, n in a.items() if g in b)
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def matches(text: str | None, ix: Index, threshold: float) -> dict[int, float]:
    """item -> highest similarity of any window, for the items that reach the threshold."""
    words = words_of(text)
    hashes = word_hashes(words)
    per_k = {k: shingle_hashes(hashes, min(k, len(words))) if words else hashes for k in ix.known}
    shared = {k: _shared(per_k[k], ix.known[k]) for k in ix.known if len(words) >= k}
    best: dict[int, float] = {}
    if not any(len(s) for s in shared.values()):
        return best
    for g in ix.groups:
        hits = shared.get(g.k)
        if hits is None or not len(hits):
            continue
        grams = g.words - g.k + 1
        if len(words) <= g.words:
            starts, last = np.zeros(1, np.int64), len(per_k[g.k])
        else:  # the windows that hold a shared shingle
            reach = np.zeros(len(words) - g.words + 2, np.int64)
            np.add.at(reach, np.clip(hits - grams + 1, 0, len(reach) - 1), 1)
            np.add.at(reach, np.clip(hits + 1, 0, len(reach) - 1), -1)
            starts, last = np.flatnonzero(reach.cumsum()[:-1] > 0), grams
        for at in range(0, len(starts), 1 << 15):
            _verify(starts[at : at + (1 << 15)], last, per_k[g.k], words, g, threshold, best)
    return best


def _verify(starts: np.ndarray, grams: int, shingles: np.ndarray, words: list[str], g: Group, threshold: float, best: dict[int, float]) -> None:
    if not len(starts):
        return
    low = starts[0]
    total = np.concatenate([np.zeros((1, 64), np.int32), signs(shingles[low : starts[-1] + grams]).cumsum(0, dtype=np.int32)])
    prints = pack(total[starts - low + grams] - total[starts - low])
    within = np.zeros((len(starts), len(g.items)), bool)
    for b in range(BLOCKS):
        within |= g.tables[b][prints[:, b]]
    wins, items = np.nonzero(within)
    close = np.bitwise_count(prints[wins] ^ g.prints[items]).sum(1) <= RADIUS
    for w, i in zip(wins[close].tolist(), items[close].tolist()):
        found = similarity(_grams(words[starts[w] : starts[w] + g.words], min(g.k, len(words))), g.shingles[i])
        if found >= threshold:
            best[g.items[i]] = max(best.get(g.items[i], 0.0), found)


def _blocks(benchmark: DataFrame, bound: int) -> list[Broadcast]:
    """The benchmark's index in parts of bounded size: each part is broadcast, and the documents pass through one part after the other."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // bound) or 1
    sc = benchmark.sparkSession.sparkContext
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [sc.broadcast(index([tuple(r) for r in items.where(part == b).orderBy("item_id", "text").collect()])) for b in range(n)]


HITS = "array<struct<item:bigint,similarity:double>>"


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, bound: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, text, others) -> doc_id, text, hits (items and their highest similarity, by item), rest (a struct of the other columns, or null).

    One row per row, whole texts; repeated rows repeat. Words are runs of letters and digits, lower-cased.
    An item or document of fewer than five words is one shingle. Null and empty texts and items without
    a word match nothing; items with a null id are left out; repeated items count once. An empty
    benchmark matches nothing, an empty table gives no rows. Other columns, whatever their names, are
    only carried along in ``rest``.
    """
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.lit(None).cast("string")
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.array().cast(HITS).alias("hits"), rest.alias("rest"))
    kind = out.schema["rest"].dataType.simpleString()
    for part in _blocks(benchmark, bound):
        out = out.mapInArrow(by_batch(_adding(part, threshold)), f"doc_id long, text string, hits {HITS}, rest {kind}")
    return out


def _adding(part: Broadcast, threshold: float):
    def run(batch):
        hits = []
        for text, before in zip(batch["text"], batch["hits"].to_pylist()):
            best = {h["item"]: h["similarity"] for h in before}
            for item, found in matches(text.as_py(), part.value, threshold).items():
                best[item] = max(best.get(item, 0.0), found)
            hits.append([{"item": i, "similarity": s} for i, s in sorted(best.items())])
        kind = pa.list_(pa.struct([("item", pa.int64()), ("similarity", pa.float64())]))
        return pa.record_batch([batch["doc_id"], batch["text"], pa.array(hits, kind), batch["rest"]], ["doc_id", "text", "hits", "rest"])

    return run
