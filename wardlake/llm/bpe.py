"""Byte-level BPE over whole texts with a pair-occurrence index.

The distinct words of a batch lie in one array of symbols. An index maps each mergeable pair, by its
rank, to all positions where it occurs. Ranks are taken in ascending order; a rank is applied at all its
positions at once, and the pairs that appear left and right of the merged symbols are added to the lists
of their own ranks. Words already met are kept as token sequences, so common words are merged once.

The vocabulary file is read on the driver (its size is fixed) and broadcast; nothing is trained.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from wardlake.llm.common import by_batch, longs

# fixed value: how the vocabulary's pre-tokenizer cuts texts into words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOGETHER = 1 << 20  # bytes of text, about, whose new words are merged in one index
KNOWN_WORDS = 100_000  # words a worker keeps between batches; beyond that it starts anew


class Vocabulary(NamedTuple):
    blob: np.ndarray  # the bytes of all tokens, one after another
    starts: np.ndarray
    sizes: np.ndarray
    of_byte: np.ndarray
    pairs: np.ndarray  # left << 17 | right, ascending
    ranks: np.ndarray  # rank of each of pairs
    left: np.ndarray  # by rank
    right: np.ndarray
    merged: np.ndarray
    specials: tuple[tuple[str, int], ...]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, letters = dict(spec["model"]["vocab"]), byte_letters()
    tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
    specials = tuple((t["content"], t["id"]) for t in spec["added_tokens"])
    tokens |= {i: t.encode() for t, i in specials}
    whole = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    sizes = np.array([len(t) for t in whole], np.int64)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    left, right = (np.array([ids[m[side]] for m in merges], np.int64) for side in (0, 1))
    merged = np.array([ids[a + b] for a, b in merges], np.int64)
    pairs = left << 17 | right
    order = np.argsort(pairs)
    of_byte = np.zeros(256, np.int64)
    for letter, b in letters.items():
        of_byte[b] = ids[letter]
    return Vocabulary(np.frombuffer(b"".join(whole), np.uint8), np.concatenate([[0], sizes.cumsum()[:-1]]), sizes, of_byte, pairs[order], order, left, right, merged, specials)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all elements of runs given by start and size, run after run."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (sizes.cumsum() - sizes), sizes)


class _Occurrences:
    """Rank -> positions of its pair, and the ranks that have any, lowest first."""

    def __init__(self):
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        firsts = ranks[np.concatenate([[0], cuts])] if len(ranks) else ranks
        for rank, part in zip(firsts.tolist(), np.split(positions, cuts)):
            have = self.lists.get(rank)
            if have is None:
                self.lists[rank] = [part]
                heapq.heappush(self.active, rank)
            else:
                have.append(part)

    def lowest(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        parts = self.lists.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def merge(symbols: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words of the given sizes, merged: the tokens of all words, and how many each word has."""
    n = len(symbols)
    sym = np.append(symbols, -1).astype(np.int32)  # the last place stands for a word's edge
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    ends = sizes.cumsum()
    after[ends - 1] = n
    before[ends - sizes] = n

    def rank_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = sym[at].astype(np.int64) << 17 | sym[after[at]]
        where = np.minimum(np.searchsorted(vocab.pairs, keys), len(vocab.pairs) - 1)
        hit = vocab.pairs[where] == keys
        return vocab.ranks[where[hit]].astype(np.int32), at[hit]

    index = _Occurrences()
    inner = np.flatnonzero(after[:n] != n).astype(np.int32)
    index.add(*rank_at(inner))
    while index.active:
        rank, at = index.lowest()
        left, right = vocab.left[rank], vocab.right[rank]
        at = at[(sym[at] == left) & (sym[after[at]] == right)]
        if left == right and len(at) > 1:  # in a run of equal symbols every other place, from the left
            fresh = np.concatenate([[True], after[at[:-1]] != at[1:]])
            first = np.flatnonzero(fresh)
            at = at[(np.arange(len(at)) - first[fresh.cumsum() - 1]) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        sym[at], sym[gone] = vocab.merged[rank], -1
        following = after[gone]
        after[at], before[following] = following, at
        touched = np.concatenate([before[at], at[following != n]])
        index.add(*rank_at(np.unique(touched[touched != n])))
    alive = sym[:n] >= 0
    owner = np.repeat(np.arange(len(sizes)), sizes)[alive]
    return sym[:n][alive], np.bincount(owner, minlength=len(sizes))


class Codec:
    """Encodes and decodes texts; keeps the token sequences of words it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.words = regex.compile(WORDS).findall
        self.special = dict(vocab.specials)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.reset()

    def reset(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _number(self, text: str) -> np.ndarray:
        """A text as numbers of words; a special token is -1 - its id."""
        if self.cut is None or not any(s in text for s in self.special):
            return np.fromiter(map(self.number.__getitem__, self.words(text)), np.int64)
        parts = [[-1 - self.special[p]] if p in self.special else [self.number[w] for w in self.words(p)] for p in self.cut(text)]
        return np.array([x for p in parts for x in p], np.int64)

    def _learn(self, words: list[str]) -> None:
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ascii_only = len(raw) == sum(map(len, words))
        sizes = np.fromiter(map(len, words) if ascii_only else (len(w.encode()) for w in words), np.int64, len(words))
        tokens, counts = merge(self.vocab.of_byte[raw], sizes, self.vocab)
        self.starts = np.concatenate([self.starts, len(self.flat) + counts.cumsum() - counts])
        self.sizes = np.concatenate([self.sizes, counts])
        self.flat = np.concatenate([self.flat, tokens])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > KNOWN_WORDS:
            self.reset()
        known = len(self.number)
        numbered = [self._number(t) for t in texts]
        if len(self.number) > known:
            self._learn(list(self.number)[known:])
        return [self._tokens(n) for n in numbered]

    def _tokens(self, numbers: np.ndarray) -> np.ndarray:
        if not len(numbers) or numbers.min() >= 0:
            return self.flat[_spans(self.starts[numbers], self.sizes[numbers])].astype("<u4")
        special = numbers < 0
        sizes = np.where(special, 1, self.sizes[np.where(special, 0, numbers)] if len(self.sizes) else 1)
        out = np.zeros(int(sizes.sum()), np.int64)
        at = sizes.cumsum() - sizes
        plain = numbers[~special]
        out[_spans(at[~special], sizes[~special])] = self.flat[_spans(self.starts[plain], self.sizes[plain])]
        out[at[special]] = -1 - numbers[special]
        return out.astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        v = self.vocab
        return v.blob[_spans(v.starts[ids], v.sizes[ids])].tobytes().decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per worker process and broadcast."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(shared.value)
    return _CODECS[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.id, self.broadcast = broadcast._jbroadcast.id(), broadcast

    def __getstate__(self):
        return {"id": self.id, "broadcast": self.broadcast}

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def shared(df: DataFrame, path: str) -> _Shared:
    return _Shared(df.sparkSession.sparkContext.broadcast(load(path)))


def _as_texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) -> doc_id, ids array<int>: one row per row; a null or empty text has no tokens; other columns are not read."""
    vocab = shared(docs, path)

    def run(batch):
        ids = _codec(vocab).encode(_as_texts(batch["text"]))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.record_batch([batch["doc_id"], pa.ListArray.from_arrays(offsets, np.concatenate(ids).astype(np.int32))], ["doc_id", "ids"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(by_batch(run, TOGETHER), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, text; null ids give the empty text."""
    vocab = shared(tokens, path)

    def run(batch):
        codec = _codec(vocab)
        out = [codec.decode(np.array(x.as_py() or [], np.int64)) for x in batch["ids"]]
        return pa.record_batch([batch["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(by_batch(run), "doc_id long, text string")


def _slices(batch: pa.RecordBatch, together: int):
    """Runs of rows of about so many bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(sizes.cumsum() // together)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        yield batch.slice(start, end - start)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text, then decodes its ids, in one pass.

    One row per row; repeated rows repeat; a null text counts as empty; a null doc_id is kept; an empty
    table gives no rows; other columns are not read.
    """
    vocab = shared(docs, path)

    def run(batch):
        codec = _codec(vocab)
        sizes, hashes, decoded = [], [], []
        for part in _slices(batch, TOGETHER):
            for x in codec.encode(_as_texts(part["text"])):
                sizes.append(len(x))
                hashes.append(hashlib.sha256(x.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(x).encode()).hexdigest())
        return pa.record_batch([batch["doc_id"], longs(sizes), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    cols = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return cols.mapInArrow(by_batch(run, TOGETHER), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
