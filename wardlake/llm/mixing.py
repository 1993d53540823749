"""Language-model scores: unigram base scores, and online logistic mixing of hashed-context bit predictors.

A text is its tokens (A-Z lower-cased, split at ASCII white space) joined by one space and closed by a
line end. Each byte is a path of bits in a prefix code, which depends on the two bytes of the word before
it. Three contexts (three bytes, five bytes, the current word so far), hashed, together with the place in
the path count zeros and ones over all training documents; the counts are fixed-size tables, so what is
broadcast does not grow with the corpus. Each count gives a prediction in the logistic domain and a
confidence. The confidences gate which set of weights mixes the predictions. Code, counts, weights and
refinement are learned from all training documents: each task goes through its documents in order,
predicts them by what it counted before, learns weights online from the errors and only then counts them;
counts are added up, weights averaged by how often their gate was open. In scoring, weights go on learning
within documents of more than STEP bits. A last table refines the mixed prediction by the byte before. The
score is the log10 probability of the whole text.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import Scratch, by_batch, longs, remainder, texts

TABLE_BITS = (18, 21, 22)
OFFSETS = np.concatenate([[0], np.cumsum([(1 << b) + 256 for b in TABLE_BITS])])  # a context's nodes may lie beyond its last slot
SLOTS = int(OFFSETS[-1])
BLOCK = 1 << 14  # slots that are added up together
FAN_IN = 64  # partial tables added up by one task
CONTEXTS = ((3, False), (5, False), (8, True))  # how many bytes back a context sees, and whether only in the current word
_TAILS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)  # the last n bytes of eight
_MIX = np.uint64(0x9E3779B97F4A7C15)
LEVELS = (1, 2, 4, 10, 40, 200)  # counts at which confidence rises
_LEVEL = np.searchsorted(np.array(LEVELS), np.arange(LEVELS[-1] + 1), side="right").astype(np.int16)
_ONE = np.array([1, 0, 0, 1], np.uint32).view(np.uint64)  # a zero and a one as a slot's pair of counts
GATES = (len(LEVELS) + 1) ** len(TABLE_BITS)
PAD = b"\n" * 8
STREAM = 1 << 16  # bytes looked at together
STEP = 11 << 10  # bits between updates of the weights
RATE = 0.005
WARM = 1 << 22  # bits of a task in which weights are learned four times as fast
FIRST = 1 << 18  # bits of a task in which texts are looked at one by one
RENEW = 2  # a task predicts by newer counts whenever it has seen so many times the bits
REFINE = 33
SCALE = 256
FIXED = 1 << 12  # summed weights are whole multiples of 1 / FIXED: their sum does not depend on the order
CODES = 512  # pairs of bytes, the commonest, with a prefix code of their own; the others share one
HEAVY = 100_000  # tokens whose counts are broadcast, each of HEAVY_BYTES at most; the others are joined
HEAVY_BYTES = 64
TALLY = 300_000  # tokens a task holds before it passes its counts on
GATHER = 4 << 20  # bytes of distinct tokens whose letters are counted together


ANY_BYTES = pc.CastOptions(pa.string(), allow_invalid_utf8=True)


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def tokenised(column: pa.Array) -> pa.ListArray:
    """The same for every text of a column of bytes; null where there are no tokens."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.cast(column, options=ANY_BYTES)))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(text, ""), None, text))


class Code(NamedTuple):
    """Prefix codes of bytes: the bits of byte b after the bytes p, q of its word are at starts[c] : starts[c] + sizes[c], c = rows[256 * p + q] + b."""

    rows: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    turns: np.ndarray  # 2 * node + bit; nodes are numbered from the root on, those met most often first. Short paths lie together: few are read often


def prefix_code(counts: np.ndarray, rows: np.ndarray | None = None) -> Code:
    """Huffman's codes of 256 symbols, one for each row of counts; every symbol has a path. By default all pairs of bytes use the first."""
    paths = [p for row in np.reshape(counts, (-1, 256)) for p in _paths(row.tolist())]
    sizes = np.array([len(p) for p in paths])
    order = np.argsort(sizes, kind="stable")
    turns = np.array([2 * node + bit for i in order.tolist() for node, bit in paths[i]], np.int16)
    starts = np.empty(len(paths), np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    rows = np.zeros(1 << 16, np.int64) if rows is None else rows * 256
    return Code(rows, starts, sizes, turns)


def _paths(counts: list[int]) -> list[list[tuple[int, int]]]:
    heap = [(n + 1, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    above, size = {}, 256
    while len(heap) > 1:
        a = heapq.heappop(heap)
        b = heap[0]
        above[a[1]], above[b[1]] = (size, 0), (size, 1)
        heapq.heapreplace(heap, (a[0] + b[0], size))
        size += 1
    found: dict[int, list] = {size - 1: []}
    for i in range(size - 2, -1, -1):
        up, bit = above[i]
        found[i] = [*found[up], (size - 1 - up, bit)]
    return [found[i] for i in range(256)]


class Bits(NamedTuple):
    slots: np.ndarray  # [context][bit]
    bits: np.ndarray
    before: np.ndarray  # the byte before
    ends: np.ndarray  # where each text's bits begin, and the last one's end


def _windows(data: bytes) -> np.ndarray:
    """The eight bytes before each place from the eighth on as one number, the last byte lowest."""
    out = np.empty(len(data) - 8, np.uint64)
    for k in range(min(8, len(out))):
        some = out[k::8]
        some[:] = np.frombuffer(data, ">u8", len(some), k)
    return out


def _within(raw: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Of the eight bytes before each place, those of the current word."""
    place = np.arange(len(raw))
    gap = np.maximum.accumulate(np.where(raw <= 32, place, 0))
    return tail & _TAILS.take(np.minimum(place[7:-1] - gap[7:-1], 8))


def _bases(tail: np.ndarray, context: int) -> np.ndarray:
    """Where the slots of a context begin; the nodes of its code follow, so that a byte's bits lie side by side."""
    mixed = tail * _MIX
    mixed >>= np.uint64(64 - TABLE_BITS[context])
    mixed += np.uint64(OFFSETS[context])
    return mixed.view(np.int64)


EVERY = tuple(range(len(CONTEXTS)))


def spell(parts: list[list[bytes]], code: Code, which: tuple[int, ...] = EVERY) -> Bits:
    """All bits of some tokenised texts with the slots of their contexts."""
    return spell_bytes([b" ".join(p) + b"\n" for p in parts], code, which)


def spell_bytes(spelled: list[bytes], code: Code, which: tuple[int, ...] = EVERY) -> Bits:
    data = PAD + PAD.join(spelled)
    raw = np.frombuffer(data, np.uint8)
    tail = _windows(data)
    word = _within(raw, tail)
    cell = code.rows.take((word & np.uint64(0xFFFF)).view(np.int64), mode="clip")
    cell += raw[8:]
    n = code.sizes.take(cell, mode="clip")
    lengths = np.array([len(s) + len(PAD) for s in spelled])
    begin = lengths.cumsum() - lengths
    n[(begin[1:, None] - np.arange(1, len(PAD) + 1)).ravel()] = 0  # no bits between texts
    first = n.cumsum() - n
    of = np.repeat(np.arange(len(n)), n)  # each bit's byte
    path = (code.starts.take(cell, mode="clip") - first).take(of, mode="clip")
    path += np.arange(len(path))
    turn = code.turns.take(path, mode="clip")
    node = np.right_shift(turn, 1, out=path)
    slots = np.empty((len(which), len(path)), np.int64)
    for out, c in zip(slots, which):
        reach, inside = CONTEXTS[c]
        _bases((word if inside else tail) & _TAILS[reach], c).take(of, mode="clip", out=out)
        out += node
    return Bits(slots, (turn & 1).astype(np.uint8), raw[7:-1].take(of, mode="clip"), np.append(first[begin], len(path)))


def streams(column: pa.Array, found: pa.ListArray):
    """Lists of (number, tokens joined and closed) of texts of about STREAM bytes together."""
    some, size = [], 0
    joined = pc.binary_join(found, " ").cast(pa.binary()).to_pylist()
    for i, (text, n) in enumerate(zip(joined, pc.binary_length(column).to_pylist())):
        some.append((i, (text or b"") + b"\n"))
        size += n or 0
        if size >= STREAM:
            yield some
            some, size = [], 0
    if some:
        yield some


def _packed(counts: np.ndarray) -> bytes:
    """As the narrowest whole numbers that hold them, whose width comes first."""
    kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or abs(counts).max(initial=0) < 1 << 8 * int(k[2]) - 1)
    return kind[2:].encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<i{data[:1].decode()}").astype(np.int64)


def learned(training: DataFrame, code: Code, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """[slot][bit] counts and a Learner's lessons over all training documents: each task fills one table, and the tables are added up FAN_IN at a time."""
    shared = training.sparkSession.sparkContext.broadcast(code)

    def fill(batches):
        learner = Learner(shared.value)
        for batch in batches:
            for some in streams(batch["text"], tokenised(batch["text"])):
                learner.see([t for _, t in some])
        part = TaskContext.get().partitionId()
        if learner.seen:
            yield _table(part, LESSONS, learner.lessons())
        for block in range(0, SLOTS, BLOCK):
            counts = learner.table[2 * block : 2 * (block + BLOCK)]
            if counts.any():
                yield _table(part, block, counts)

    def add(tables):
        total = sum(_unpacked(data.as_py()) for data in tables["counts"])
        return pa.table({"part": tables["part"][:1], "block": tables["block"][:1], "counts": pa.array([_packed(total)], pa.binary())})

    schema = "part long, block long, counts binary"
    tables = training.select("text").mapInArrow(fill, schema)
    parts = training.rdd.getNumPartitions()
    while parts > 0:
        tables = tables.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("part", "block").applyInArrow(add, schema)
        parts = 0 if parts <= FAN_IN else -(-parts // FAN_IN)
        if parts > 0:
            tables = scratch.keep(tables)
    out, lessons = np.zeros(2 * SLOTS, np.float32), Learner(code).lessons()  # large counts need no last digits
    for row in tables.coalesce(8).toLocalIterator():
        found = _unpacked(bytes(row["counts"]))
        if row["block"] == LESSONS:
            lessons = found
        else:
            out[2 * row["block"] : 2 * (row["block"] + BLOCK)] = found
    return out.reshape(SLOTS, 2), lessons


LESSONS = -1  # stands in place of a block's number


def _table(part: int, block: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([longs([part]), longs([block]), pa.array([_packed(counts)], pa.binary())], ["part", "block", "counts"])


class Model(NamedTuple):
    code: Code
    known: np.ndarray  # by slot: the logarithm of the odds of a one in steps of 1 / SCALE, times 8, plus how sure the counts are
    weights: np.ndarray  # [context][gate]
    refine: np.ndarray  # [byte before * REFINE + stretched prediction] -> probability


def facts(counts: np.ndarray) -> np.ndarray:
    n0, n1 = counts[..., 0].astype(np.float32), counts[..., 1].astype(np.float32)
    odds = np.rint(np.clip(np.log((n1 + np.float32(0.3)) / (n0 + np.float32(0.3))), -8, 8) * SCALE)
    return (odds * 8).astype(np.int16) + _LEVEL.take(np.minimum(n0 + n1, LEVELS[-1]).astype(np.int16))


def all_facts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([facts(counts[i : i + BLOCK]) for i in range(0, SLOTS, BLOCK)])


def _squash(x: np.ndarray) -> np.ndarray:
    out = np.exp(-x)
    out += 1
    return np.divide(1, out, out=out)


def _place(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where the refinement of a mixed prediction after a byte is kept."""
    cell = x + np.float32(8)
    np.clip(cell, 0, 16, out=cell)
    cell *= np.float32((REFINE - 1) / 16)
    cell += np.float32(0.5)
    out = before * np.int64(REFINE)
    out += cell.astype(np.int32)
    return out


def unfold(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[context][bit] of what is known -> stretched predictions and gates."""
    gate = known[0] & 7
    for row in known[1:]:
        gate *= np.int16(len(LEVELS) + 1)
        gate += row & 7
    return (known >> 3) * np.float32(1 / SCALE), gate.astype(np.int64)


def mixed_by(stretch: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = weights[0].take(gate, mode="clip") * stretch[0]
    for w, s in zip(weights[1:], stretch[1:]):
        out += w.take(gate, mode="clip") * s
    return np.clip(out, -12, 12, out=out)


def learn(weights: np.ndarray, stretch: np.ndarray, gate: np.ndarray, chance: np.ndarray, bits: np.ndarray, rate: float) -> np.ndarray:
    """One online step on the bits just predicted, in place. Returns how often each gate was open."""
    error = bits - chance
    sums = np.zeros((2, GATES), np.complex128)  # two sums in one pass
    both = np.empty(len(bits), np.complex128)
    both.real, both.imag = error * stretch[0], error * stretch[1]
    np.add.at(sums[0], gate, both)
    both.real, both.imag = error * stretch[2], 1
    np.add.at(sums[1], gate, both)
    opened = sums[1].imag
    weights += rate * np.stack([sums[0].real, sums[0].imag, sums[1].real]) / np.sqrt(np.maximum(opened, 1))
    return opened


def mix(stretch: np.ndarray, gate: np.ndarray, bits: np.ndarray, weights: np.ndarray, rate: float, carry: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mixed predictions (stretched, and as chances of a one) of a text's bits in order, and how often each gate was open where weights were learned; they learn after every step, in place, after the last one only if they are carried on to another text."""
    mixed, chance, opened = np.empty(len(bits), np.float32), np.empty(len(bits), np.float32), np.zeros(GATES)
    for at in range(0, len(bits), STEP):
        here = slice(at, at + STEP)
        mixed[here] = mixed_by(stretch[:, here], gate[here], weights)
        chance[here] = _squash(mixed[here])
        if at + STEP < len(bits) or carry:
            opened += learn(weights, stretch[:, here], gate[here], chance[here], bits[here], rate)
    return mixed, chance, opened


def cost(mixed: np.ndarray, bits: np.ndarray, before: np.ndarray, refine: np.ndarray, chance: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the probability of each bit: the mean of the mixed prediction (its chance of a one, if known already) and its refinement."""
    p = refine.take(_place(mixed, before), mode="clip")
    p += _squash(mixed) if chance is None else chance
    p *= np.float32(0.5)
    p -= 1 - bits
    return np.log(np.abs(p, out=p), out=p)  # 1 - p where the bit is 0


class Learner:
    """Goes through texts in order: predicts each by what was counted before it, learns weights and refinement from the errors, then counts it."""

    def __init__(self, code: Code):
        self.code = code
        self.table = np.zeros(2 * SLOTS, np.uint32)  # [slot * 2 + bit]
        self.known = np.zeros(SLOTS, np.int16)
        self.weights = np.full((len(CONTEXTS), GATES), 0.4, np.float32)
        self.opened = np.zeros(GATES, np.int64)
        self.hits = np.zeros(2 * 256 * REFINE, np.int64)
        self.seen, self.renewed = 0, 0

    def see(self, texts: list[bytes]) -> None:
        """The first texts count before the next is looked at, later ones together."""
        for some in [[t] for t in texts] if self.seen < FIRST else [texts]:
            self._see(some)

    def _see(self, texts: list[bytes]) -> None:
        spelled = spell_bytes(texts, self.code)
        stretch, gate = unfold(self.known.take(spelled.slots, mode="clip"))
        mixed, _, opened = mix(stretch, gate, spelled.bits, self.weights, RATE * (4 if self.seen < WARM else 1), True)
        self.opened += opened.astype(np.int64)
        self.hits += np.bincount(_place(mixed, spelled.before) + spelled.bits * np.int64(256 * REFINE), minlength=len(self.hits))
        ones, pairs = _ONE.take(spelled.bits), self.table.view(np.uint64)
        for row in spelled.slots:
            np.add.at(pairs, row, ones)  # with other index or value types adding in place is twenty times slower
        self.seen += len(spelled.bits)
        if self.seen >= RENEW * self.renewed:
            self.renewed = self.seen
            for at in range(0, SLOTS, 16 * BLOCK):
                counts = self.table[2 * at : 2 * (at + 16 * BLOCK)]
                used = np.flatnonzero(counts.view(np.uint64))
                self.known[at + used] = facts(counts.reshape(-1, 2)[used])

    def lessons(self) -> np.ndarray:
        """What is added up over tasks: weights times how often their gate was open, that number, and the refinement's counts."""
        weighed = np.rint(self.weights.astype(np.float64) * self.opened * FIXED).astype(np.int64)
        return np.concatenate([weighed.ravel(), self.opened, self.hits])


def settle(counts: np.ndarray, code: Code, lessons: np.ndarray) -> Model:
    weighed, opened, hits = np.split(lessons, [len(CONTEXTS) * GATES, (len(CONTEXTS) + 1) * GATES])
    weights = np.where(opened > 0, weighed.reshape(-1, GATES) / FIXED / np.maximum(opened, 1), 0.4).astype(np.float32)
    hits = hits.reshape(2, 256 * REFINE)
    grid = np.tile(_squash(np.linspace(-8, 8, REFINE)), 256)
    refine = (hits[1] + 20 * grid) / (hits.sum(0) + 20)
    return Model(code, all_facts(counts), weights, np.clip(refine, 1e-5, 1 - 1e-5).astype(np.float32))


def fit(samples: list[list[bytes]], counts: np.ndarray, code: Code) -> Model:
    """A model with the given counts and what is learned in one place from some texts in order."""
    learner = Learner(code)
    for sample in samples:
        learner.see([b" ".join(sample) + b"\n"])
    return settle(counts, code, learner.lessons())


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """log10 probability of each text, its tokens joined and closed; the texts do not influence each other."""
    spelled = spell_bytes(texts, model.code)
    stretch, gate = unfold(model.known.take(spelled.slots, mode="clip"))
    mixed, chance, done = np.empty(len(gate), np.float32), np.empty(len(gate), np.float32), 0
    for k in [*np.flatnonzero(np.diff(spelled.ends) > STEP), len(texts)]:
        a, b = spelled.ends[k], spelled.ends[min(k + 1, len(texts))]
        mixed[done:a] = mixed_by(stretch[:, done:a], gate[done:a], model.weights)
        chance[done:a] = _squash(mixed[done:a])
        mixed[a:b], chance[a:b], _ = mix(stretch[:, a:b], gate[a:b], spelled.bits[a:b], model.weights.copy(), RATE)
        done = b
    each = cost(mixed, spelled.bits, spelled.before, model.refine, chance)
    return np.add.reduceat(each, spelled.ends[:-1], dtype=np.float64) / np.log(10)


def count_tokens(training: DataFrame) -> DataFrame:
    """token, c: over all training documents; counted in each task first."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            each = tokenised(batch["text"]).flatten().value_counts()
            held.append(pa.table({"token": each.field("values").cast(pa.binary()), "n": each.field("counts")}))
            rows += len(each)
            if rows > 2 * TALLY:
                held = [_tallied(held)]
                rows = held[0].num_rows
                if rows > TALLY:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if rows:
            yield from _tallied(held).to_batches()

    return training.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def _tallied(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])


def letter_code(counts: DataFrame) -> Code:
    """Prefix codes from all training tokens: for each of the CODES commonest pairs of bytes in a word what follows, for the others and on the whole what follows any."""

    def run(batch):
        data = PAD + b" ".join(batch["token"].to_pylist()) + b" "
        raw = np.frombuffer(data, np.uint8)
        word = _within(raw, _windows(data)) & np.uint64(0xFFFF)
        times = np.repeat(batch["c"].to_numpy(), [len(t) + 1 for t in batch["token"].to_pylist()])
        found, which = np.unique(word.astype(np.int64) * 256 + raw[8:], return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, which, times)
        return pa.record_batch([longs(found >> 8), longs(found & 255), longs(total)], ["pair", "letter", "n"])

    letters = counts.select("token", "c").mapInArrow(by_batch(run, GATHER), "pair long, letter long, n long").groupBy("pair", "letter").agg(F.sum("n").alias("n")).persist()
    every = letters.groupBy("letter").agg(F.sum("n")).collect()
    pairs = [r[0] for r in letters.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "pair").limit(CODES).collect()]
    rows, table = np.zeros(1 << 16, np.int64), np.zeros((len(pairs) + 1, 256), np.int64)
    rows[pairs] = np.arange(1, len(pairs) + 1)
    for letter, n in every:
        table[0, letter] = n
    for pair, letter, n in letters.where(F.col("pair").isin(pairs)).collect():
        table[rows[pair], letter] = n
    letters.unpersist()
    return prefix_code(table, rows)


def score(docs: DataFrame, folds: int = 7, held: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    One row per row, whole texts; repeated rows repeat and are each counted. A null or empty text has one
    token, the end; a null doc_id counts as the empty text in the fold; an empty table gives no rows; with
    no training document every token is unknown and each bit is a guess. Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    plain = texts(docs)
    held_out = remainder(F.col("doc_id"), folds) == held
    training = plain.where(~held_out)
    counts = scratch.keep(count_tokens(training))
    known = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    n_train = training.select("doc_id").count()
    kinds, total = known[0] + (n_train > 0), known[1] + n_train
    common = counts.where(F.length("token") <= HEAVY_BYTES).orderBy(F.col("c").desc(), "token").limit(HEAVY).toPandas()
    heavy = sc.broadcast((pa.array(common["token"], pa.binary()), np.append(np.log10(common["c"].to_numpy(float) + 1), 0)))
    code = letter_code(counts)
    bits, lessons = learned(training, code, scratch)
    model = sc.broadcast(settle(bits, code, lessons))
    del bits
    found = scratch.keep(_look(plain.withColumn("held_out", held_out).withColumn("row", F.monotonically_increasing_id()), heavy, model, n_train), from_scan=True)
    rare = found.select("row", F.explode("rare").alias("r")).select("row", F.col("r.token").alias("token"), F.col("r.n").alias("n"))
    met = rare.join(counts, "token").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    met = scratch.keep(met)
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + 1 * (kinds + 1))))
    return found.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), logs.alias("base_score"), "score")


def _look(rows: DataFrame, heavy: Broadcast, model: Broadcast, n_train: int) -> DataFrame:
    """Per row what the broadcast counts say, the model's score, and the tokens that are not among the broadcast ones."""
    def run(batch):
        (names, logarithms), n = heavy.value, batch.num_rows
        found, score = tokenised(batch["text"]), np.zeros(n)
        for some in streams(batch["text"], found):
            score[[i for i, _ in some]] = scores([t for _, t in some], model.value)
        sizes, words = found.value_lengths().fill_null(0).to_numpy().astype(np.int64), found.flatten().cast(pa.binary())
        place = pc.index_in(words, value_set=names).fill_null(-1).to_numpy()
        of = np.repeat(np.arange(n), sizes)
        n_known = np.bincount(of[place >= 0], minlength=n) + int(n_train > 0)
        logs = np.bincount(of, weights=logarithms[place], minlength=n) + np.log10(n_train + 1)
        left = np.flatnonzero(place < 0)
        ends = np.searchsorted(left, np.concatenate([[0], sizes.cumsum()])).tolist()
        left = words.take(pa.array(left)).to_pylist()
        lists = [Counter(left[a:b]) for a, b in zip(ends, ends[1:])]
        rare, times = [w for r in lists for w in r], [k for r in lists for k in r.values()]
        pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), longs(times)], ["token", "n"])
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, lists)]).astype(np.int32), pairs)
        return pa.record_batch([batch["row"], batch["doc_id"], batch["held_out"], longs(sizes + 1), longs(n_known), pa.array(logs), pa.array(score), lists], ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare"])

    return rows.select("row", "doc_id", "held_out", "text").mapInArrow(by_batch(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<struct<token:binary,n:bigint>>")
