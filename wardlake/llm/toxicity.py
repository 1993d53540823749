"""Toxicity by a subsequence string kernel: a support vector machine on Nyström features of landmark sentences.

The kernel compares two stretches of text by the letter triples they share as subsequences: the second
and third letter may each follow the one before directly or with one symbol between, each skipped symbol
weighing DECAY. So an insult still matches with characters put between its letters, or with endings of
its own. Landmarks are labelled stretches; the machine is trained on the kernel values to the landmarks,
whitened (Nyström). Its score of a stretch is then a sum over the stretch's triples, so the whole model
folds into one weight per triple: scoring reads each text once, however many landmarks there are.

A text's margin is that of its worst stretch of WINDOW symbols, over every stretch of the whole text.
The labels say of whole texts whether they are toxic; which stretch of a toxic text is meant is found by
training in rounds, each taking the stretch that the round before scores highest.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import by_batch, remainder

SIZE = 28  # 0: what is no letter (a run of it is one symbol), 1-26: a-z with accents off, 27: other letters
TRIPLES = SIZE**3
DECAY = 0.6
GAPS = ((1, 1), (1, 2), (2, 1), (2, 2))
REACH = 4  # symbols after the first that a triple can touch
WINDOW = 15
UNIT = float(np.sqrt(WINDOW * sum(DECAY ** (2 * (a + b - 2)) for a, b in ((1, 1), (1, 2), (2, 1), (2, 2)))))  # length of the triple vector of a stretch that repeats nothing
LANDMARKS = 320
TRAIN_TOXIC, TRAIN_CLEAN = 1500, 2500  # labelled texts the machine is fitted on, those with the smallest hash of their id; a documented bound
TRAIN_CHARS = 12_000_000  # and no more than so many characters of them
ROUNDS = 4
PEAKS, PEAK_SHARE = 4, 0.6  # stretches of a toxic text that stand for it in training
PIECE = 1 << 20  # characters scored at once


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The symbol of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c.lower())[0]
            out[i] = ord(base) - 96 if "a" <= base <= "z" else 27
    out[ord("ß")] = ord("s") - 96
    out[0x3000:0x20000] = 27
    return out


def symbols_of(text: str) -> np.ndarray:
    """The symbols of a text, with room for triples at its end; single letters set apart from each other are put together."""
    s = symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = np.concatenate([np.zeros(1, np.uint8), s[keep], np.zeros(1 + REACH, np.uint8)])
    between = np.zeros(len(s), bool)
    between[2:-2] = (s[2:-2] == 0) & (s[:-4] == 0) & (s[4:] == 0) & (s[1:-3] != 0) & (s[3:-1] != 0)
    return s[~between]


def triples(s: np.ndarray) -> np.ndarray:
    """[gap][position]: the triples that start at each position of a symbol sequence with REACH symbols to spare."""
    s = s.astype(np.int32)
    n = len(s) - REACH
    return np.stack([(s[:n] * SIZE + s[a : a + n]) * SIZE + s[a + b : a + b + n] for a, b in GAPS])


WEIGHTS = np.array([DECAY ** (a + b - 2) for a, b in GAPS], np.float32)


class Model(NamedTuple):
    weights: np.ndarray  # one per triple
    knee: float  # margins beyond it are those of the normalised kernel
    slope: float
    offset: float


def position_scores(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    t = triples(s)
    out = np.zeros(t.shape[1], np.float32)
    for row, w in zip(t, WEIGHTS):
        out += w * weights[row]
    return out


def window_sums(scores: np.ndarray) -> np.ndarray:
    """The sum over each stretch of WINDOW positions; a shorter text is one stretch."""
    if len(scores) <= WINDOW:
        return np.array([scores.sum()])
    total = np.concatenate([[0.0], scores.cumsum(dtype=np.float64)])
    return total[WINDOW:] - total[:-WINDOW]


def lengths(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The length of the triple vector of the stretches that begin at the given positions; at least UNIT."""
    t = triples(np.concatenate([s, np.zeros(WINDOW, np.uint8)]))
    out = np.zeros(len(at))
    for i in range(0, len(at), 4096):
        some = at[i : i + 4096]
        places = some[:, None] + np.arange(WINDOW)
        keys = np.concatenate([t[g][places] for g in range(len(GAPS))], axis=1) + np.arange(len(some))[:, None] * TRIPLES
        weight = np.broadcast_to(np.repeat(WEIGHTS, WINDOW), keys.shape) * (keys % TRIPLES != 0)
        found, which = np.unique(keys.ravel(), return_inverse=True)
        sums = np.bincount(which, weights=weight.ravel())
        out[i : i + 4096] = np.sqrt(np.bincount(found // TRIPLES, weights=sums * sums, minlength=len(some)))
    return np.maximum(out, UNIT)


def stretch_margins(s: np.ndarray, weights: np.ndarray, knee: float) -> np.ndarray:
    """The margin of each stretch. A stretch that repeats itself has a longer triple vector; as no vector is shorter than
    UNIT, only stretches that pass the knee by that length need their own, and they do not fall below the knee."""
    out = window_sums(position_scores(s, weights)) / UNIT
    high = np.flatnonzero(out > knee)
    if len(high):
        out[high] = np.maximum(out[high] * UNIT / lengths(s, high), knee)
    return out


def margin(text: str, weights: np.ndarray, knee: float) -> float:
    """The highest margin of any stretch; read in pieces that overlap by more than a stretch."""
    best = -np.inf
    for at in range(0, max(len(text), 1), PIECE):
        part = text[max(0, at - 4 * WINDOW) : at + PIECE]
        best = max(best, float(stretch_margins(symbols_of(part), weights, knee).max()))
    return best


def margins(texts: list[str], weights: np.ndarray, knee: float) -> np.ndarray:
    """The margin of each text. Short texts are laid end to end and scored together, no stretch bridging two of them; those that pass the knee are looked at one by one."""
    out = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= PIECE):
            chars += len(texts[stop])
            stop += 1
        if chars > PIECE:
            out[at] = margin(texts[at], weights, knee)
        else:
            out[at:stop] = _together(texts[at:stop], weights) / UNIT
            for i in np.flatnonzero(out[at:stop] > knee):
                out[at + i] = margin(texts[at + i], weights, knee)
        at = stop
    return out


def _together(texts: list[str], weights: np.ndarray) -> np.ndarray:
    parts = [symbols_of(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    starts = sizes.cumsum() - sizes
    scores = position_scores(np.concatenate([*parts, np.zeros(REACH, np.uint8)]), weights)
    total = np.concatenate([[0.0], scores.cumsum(dtype=np.float64)])
    ends = starts + sizes - REACH  # positions whose triple lies in the text
    last = np.maximum(ends - WINDOW, starts)
    sums = total[np.minimum(np.arange(len(scores)) + WINDOW, len(scores))] - total[:-1]
    sums[last] = total[np.minimum(last + WINDOW, ends)] - total[last]
    inside = np.full(len(scores), -np.inf)
    inside[_ranges(starts, last + 1 - starts)] = sums[_ranges(starts, last + 1 - starts)]
    return np.maximum.reduceat(inside, starts)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) + np.repeat(starts - (sizes.cumsum() - sizes), sizes)


def _features(stretches: list[np.ndarray]) -> np.ndarray:
    """Triple vectors of stretches, normalised to length one: [stretch][triple]."""
    out = np.zeros((len(stretches), TRIPLES), np.float32)
    for i, s in enumerate(stretches):
        for row, w in zip(triples(s), WEIGHTS):
            np.add.at(out[i], row, w)
        out[i, 0] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def _peaks(margins: np.ndarray, most: int) -> list[int]:
    """The highest stretch, and further ones apart from it that reach PEAK_SHARE of its margin."""
    left, out = margins.copy(), []
    while len(out) < most:
        at = int(np.argmax(left))
        if out and left[at] < max(PEAK_SHARE * margins[out[0]], 1e-9):
            break
        out.append(at)
        left[max(0, at - WINDOW) : at + WINDOW + 1] = -np.inf
    return out


def _stretch(s: np.ndarray, at: int) -> np.ndarray:
    return s[at : at + WINDOW + REACH]


def _svm(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, c: float = 3.0, passes: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss) by dual coordinate descent; the last column of x is 1; the two classes weigh the same."""
    cost = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1))) / 10
    alpha, w, norms = np.zeros(len(y)), np.zeros(x.shape[1]), np.einsum("ij,ij->i", x, x)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / norms[i], 0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton steps."""
    scale = max(float(x.std()), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], 1)
    weight = np.ones(len(y))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        grad = z.T @ (weight * (p - (y > 0))) + 1e-2 * b
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        b -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(b[0] / scale), float(b[1])


def fit(texts: list[str], toxic: list[int], seed: int = 5) -> Model:
    """Landmarks, Nyström features and the machine, in rounds; with one class or none, a model that rejects nothing."""
    rng = np.random.default_rng(seed)
    y = np.where(np.array(toxic, int) > 0, 1, -1)
    seqs = [symbols_of(t) for t in texts]
    pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
    if not len(pos) or not len(neg):
        return Model(np.zeros(TRIPLES, np.float32), 0.0, 1.0, -20.0)
    seen = np.zeros((2, TRIPLES))
    for s, label in zip(seqs, y):
        seen[int(label > 0), np.unique(triples(s))] += 1
    # the first round's guess: triples met in more toxic texts than in clean ones
    weights = np.maximum(np.log((seen[1] + 1) / (len(pos) + 2)) - np.log((seen[0] + 1) / (len(neg) + 2)), 0) * (seen[1] >= 3)
    weights, knee = weights.astype(np.float32), np.inf
    for _ in range(ROUNDS):
        spots = [stretch_margins(s, weights, knee) for s in seqs]
        worst = {i: [_stretch(seqs[i], at) for at in _peaks(spots[i], PEAKS)] for i in range(len(seqs))}
        chance = [_stretch(seqs[i], int(rng.integers(len(spots[i])))) for i in neg]
        bad = [w for i in pos for w in worst[i]]
        items = bad + [w for i in neg for w in worst[i][:1]] + chance
        labels = np.array([1] * len(bad) + [-1] * (2 * len(neg)))
        half = LANDMARKS // 2
        marks = np.concatenate([rng.permutation(len(bad))[:half], len(bad) + rng.permutation(2 * len(neg))[: LANDMARKS - half]])
        z = _features([items[i] for i in marks])
        values, vectors = np.linalg.eigh((z @ z.T).astype(float))
        whiten = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        x = np.ones((len(items), len(marks) + 1))
        for i in range(0, len(items), 200):  # the triple vectors of all stretches at once would need a gigabyte
            x[i : i + 200, :-1] = (_features(items[i : i + 200]) @ z.T) @ whiten
        w, bias = _svm(x, labels, rng)
        weights = (z.T @ (whiten @ w).astype(np.float32)).astype(np.float32)
        weights[0], knee = 0, max(-bias - 1.0, 0.0)
    slope, offset = _logistic(margins(texts, weights, knee), y)
    return Model(weights, float(knee), slope, offset)


def probability(model: Model, found: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * found + model.offset, -500, 500)))


def sampled(known: list[tuple[int, int]], most: int) -> list[int]:
    """Places of texts given as (label, size) in order: each class has its part of most characters, and what the smaller one leaves goes to the other.

    A text that does not fit is passed over; a class of which none fits has its shortest text.
    """
    size = {label: sum(n for k, n in known if k == label) for label, _ in known}
    out, left = [], most
    for todo, label in zip(range(len(size), 0, -1), sorted(size, key=size.get)):
        mine, room = [], left // todo
        for i, (k, n) in enumerate(known):
            if k == label and n <= room:
                mine.append(i)
                room -= n
        mine = mine or [min((i for i, x in enumerate(known) if x[0] == label), key=lambda i: known[i][1])]
        left -= sum(known[i][1] for i in mine)
        out += mine
    return sorted(out)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Fit on a bounded sample of the labelled documents whose crc32(doc_id) mod folds is not 0."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.where((remainder(F.col("doc_id"), folds) != 0) & F.col("toxic").isNotNull()).withColumn("order", F.xxhash64("doc_id"))
    chosen = None
    for label, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        part = known.where(F.col("toxic") == label).orderBy("order", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select("doc_id", "text").where("text is not null")
    sizes = texts.select("doc_id", F.length("text").alias("size")).join(F.broadcast(chosen.select("doc_id", "toxic", "order")), "doc_id").orderBy("order", "doc_id", "size").collect()
    if not sizes:
        return fit([], [])
    # by length, before texts are moved
    taken = [sizes[i] for i in sampled([(r["toxic"], r["size"]) for r in sizes], TRAIN_CHARS)]
    picked = docs.sparkSession.createDataFrame(sorted({(r["doc_id"], r["toxic"], r["order"], r["size"]) for r in taken}), "doc_id long, toxic int, order long, size int")
    rows = texts.withColumn("size", F.length("text")).join(F.broadcast(picked), ["doc_id", "size"]).select("order", "doc_id", "toxic", "text")

    def run(batches):
        sample = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda r: (r["order"], r["doc_id"]))
        model = fit([r["text"] for r in sample], [r["toxic"] for r in sample])
        yield pa.record_batch([pa.array([model.weights.tobytes()], pa.binary()), *[pa.array([x]) for x in model[1:]]], ["weights", "knee", "slope", "offset"])

    # one task fits on the bounded sample, so the driver gets the weights only
    row = rows.repartition(1).mapInArrow(run, "weights binary, knee double, slope double, offset double").first()
    if row is None:
        return fit([], [])
    return Model(np.frombuffer(bytes(row["weights"]), np.float32), *row[1:])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, score: one row per row; a null text scores as the empty one; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m = shared.value
        found = margins([t or "" for t in batch["text"].to_pylist()], m.weights, m.knee)
        return pa.record_batch([batch["doc_id"], pa.array(probability(m, found))], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(by_batch(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m = shared.value
        found = margins([t or "" for t in batch["text"].to_pylist()], m.weights, m.knee)
        return batch.filter(pa.array(probability(m, found) < threshold))

    return docs.mapInArrow(by_batch(run), docs.schema)
