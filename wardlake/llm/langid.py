"""Language identification by cross-parsing: the language whose labelled text parses a text into the fewest phrases.

For each language a suffix automaton is built of labelled text. A text is parsed greedily: the longest
stretch that occurs in the language's text is a phrase, the next one begins where it ended. Few phrases
mean long matches, so a small cross-entropy. All automata are laid out as one transition table in which a
missing transition already begins the next phrase, and many texts are parsed side by side, one symbol of
each at a time. Texts are parsed in segments of SEGMENT symbols, each begun afresh. Languages have as much
labelled text as they have; a phrase costs the bits of its place in that text and of the symbol that ends
it, so that counts over automata of unlike size can be compared.
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

CLASSES = 48  # symbols: 0 for what is no letter, 1 for letters that are in no labelled text, the others by frequency
TRAIN_DOCS = 600  # labelled documents per language, those with the smallest hash of their id; a documented bound
TRAIN_SYMBOLS = 120_000  # symbols of labelled text for all languages together, dealt out by budgets()
GATHER = 4  # so many times a language's even share is gathered, as cleaning leaves stretches out
STRETCH = 100  # symbols of labelled text that are kept or left out together
SEGMENT = 256
PIECE = 1 << 21  # symbols parsed side by side
RESTART = 1 << 30


@lru_cache(maxsize=1)
def lower_letters() -> np.ndarray:
    """Each code point's lower-case letter; 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        if c.isalpha() if i < 0x20000 else unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters, each run of anything else as one 0."""
    x = lower_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    return x[keep]


def suffix_automaton(symbols: list[int]) -> np.ndarray:
    """The transition table of all substrings of a sequence: [state][symbol] -> state, -1 for none; state 0 is the empty string."""
    n = 2 * len(symbols) + 2
    step = np.full((n, CLASSES), -1, np.int32)
    link, longest = [-1] * n, [0] * n
    size, last = 1, 0
    for c in symbols:
        cur, size = size, size + 1
        longest[cur] = longest[last] + 1
        p = last
        while p != -1 and step[p, c] < 0:
            step[p, c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = int(step[p, c])
            if longest[p] + 1 == longest[q]:
                link[cur] = q
            else:
                copy, size = size, size + 1
                longest[copy], link[copy] = longest[p] + 1, link[q]
                step[copy] = step[q]
                while p != -1 and step[p, c] == q:
                    step[p, c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return step[:size]


class Model(NamedTuple):
    languages: list[str]
    classes: np.ndarray  # sorted letters that have a symbol of their own
    symbol: np.ndarray  # and that symbol
    table: np.ndarray  # [state * CLASSES + symbol] -> place of the next state's row, with RESTART if a phrase begins there
    roots: np.ndarray
    price: np.ndarray | None = None  # bits of a phrase, by language


def symbols_in(letters: np.ndarray, classes: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    out = (letters != 0).astype(np.int32)
    if len(classes):
        at = np.minimum(np.searchsorted(classes, letters), len(classes) - 1)
        hit = classes[at] == letters
        out[hit] = symbol[at[hit]]
    return out


def budgets(sizes: dict[str, int]) -> dict[str, int]:
    """Symbols of each language, TRAIN_SYMBOLS in all: half is dealt out evenly, half by what there is; what a language cannot use goes to the others.

    So neither does a small language take text from the large ones, nor does a long tail of them.
    """
    weight = {k: 1 / len(sizes) + n / max(sum(sizes.values()), 1) for k, n in sizes.items()}
    out, left, open_ = {}, TRAIN_SYMBOLS, set(sizes)
    while open_:
        each = left / sum(weight[k] for k in open_)
        small = {k for k in open_ if sizes[k] <= each * weight[k]}
        out |= {k: sizes[k] if small else int(each * weight[k]) for k in small or open_}
        left -= sum(sizes[k] for k in small)
        open_ = open_ - small if small else set()
    return out


def stretches(letters: np.ndarray, most: int, start: float = 0.5) -> list[np.ndarray]:
    """All of a text in stretches, or most // STRETCH of them at even distances over the whole of it; start (0 to 1) says where in its part each lies."""
    n = max(most // STRETCH, 1)
    if len(letters) <= n * STRETCH:
        return [letters[i : i + STRETCH] for i in range(0, len(letters), STRETCH)]
    return [letters[at : at + STRETCH] for at in (int((len(letters) - STRETCH) * (i + start) / n) for i in range(n))]


def spread(parts: list[np.ndarray], most: int) -> np.ndarray:
    """Stretches of all parts evenly, so many symbols at most; everything if that is no more."""
    total = sum(map(len, parts))
    if total <= most:
        return np.concatenate(parts)
    out, taken, seen = [parts[0][:0]], 0, 0
    for piece in (t[i : i + STRETCH] for t in parts for i in range(0, len(t), STRETCH)):
        seen += len(piece)
        if taken + len(piece) <= seen * most / total:
            out.append(piece)
            taken += len(piece)
    return np.concatenate(out)


def build(texts: dict[str, list[np.ndarray]]) -> Model:
    """The automata of languages given as letters of their labelled texts."""
    languages = sorted(texts)
    share = budgets({lang: sum(map(len, t)) for lang, t in texts.items()})
    everything = np.concatenate([x for t in texts.values() for x in t]) if languages else np.zeros(0, np.uint32)
    values, counts = np.unique(everything[everything != 0], return_counts=True)
    top = values[np.argsort(-counts, kind="stable")[: CLASSES - 2]]
    order = np.argsort(top)
    classes, symbol = top[order], (order + 2).astype(np.int32)
    tables, roots, price, size = [], [], [], 0
    for lang in languages:
        body = symbols_in(spread(texts[lang], share[lang]), classes, symbol).tolist()
        step = suffix_automaton(body)
        fresh = step[0].copy()
        fresh[fresh < 0] = 0  # a symbol that the language lacks is a phrase of its own
        full = np.where(step >= 0, step + size, (fresh + size)[None, :] + RESTART)
        rows = np.where(full >= RESTART, (full - RESTART) * CLASSES + RESTART, full * CLASSES)
        rows[0] = (fresh + size) * CLASSES + RESTART  # from the empty string every symbol begins a phrase
        tables.append(rows.astype(np.int32).ravel())
        roots.append(size * CLASSES)
        price.append(np.log2(max(len(body), 2)) + np.log2(CLASSES))
        size += len(step)
    return Model(languages, classes, symbol, np.concatenate(tables) if tables else np.zeros(0, np.int32), np.array(roots, np.int64), np.array(price))


def phrases(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """[sequence][language]: the number of phrases."""
    sizes = np.array([len(s) for s in sequences])
    cuts = np.maximum(-(-sizes // SEGMENT), 1)
    owner = np.repeat(np.arange(len(sequences)), cuts)
    part = np.arange(len(owner)) - np.repeat(cuts.cumsum() - cuts, cuts)
    length = np.minimum(sizes[owner] - part * SEGMENT, SEGMENT)
    begin = np.repeat(sizes.cumsum() - sizes, cuts) + part * SEGMENT
    flat = np.concatenate([*sequences, np.zeros(SEGMENT, np.int32)])
    order = np.argsort(-length, kind="stable")
    begin, ends = begin[order], length[order]
    active = np.searchsorted(-ends, -np.arange(SEGMENT), side="left")  # segments longer than j
    state = np.repeat(model.roots[:, None], len(order), axis=1).astype(np.int32)
    count = np.zeros(state.shape, np.int32)
    for j in range(SEGMENT):
        n = active[j]
        if not n:
            break
        c = flat[begin[:n] + j]
        for k in range(len(model.languages)):
            now = model.table[state[k, :n] + c]
            count[k, :n] += now >> 30
            state[k, :n] = now & (RESTART - 1)
    out = np.zeros((len(sequences), len(model.languages)))
    for k in range(len(model.languages)):
        out[:, k] = np.bincount(owner[order], weights=count[k], minlength=len(sequences))
    return out


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The language of each text and a confidence; ``und`` with confidence 0 for a null text or one without a letter."""
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    names, sure = np.full(len(texts), "und", object), np.zeros(len(texts))
    at = 0
    while at < len(texts):
        seqs, places, total = [], [], 0
        while at < len(texts) and (not seqs or total < PIECE):
            letters = letters_of(texts[at] or "")
            if letters.any():
                seqs.append(symbols_in(letters, model.classes, model.symbol))
                places.append(at)
                total += len(letters)
            at += 1
        if seqs:
            found = phrases(seqs, model) * model.price
            best = found.argmin(1)  # ties go to the first name in order
            rate = found / np.array([len(s) for s in seqs])[:, None]
            odds = np.exp2(rate.min(1, keepdims=True) - rate)
            names[places] = np.array(model.languages, object)[best]
            sure[places] = 1 / odds.sum(1)
    return list(names), sure


def train(docs: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """Automata of labelled documents whose crc32(doc_id) mod folds is not held.

    A bounded sample per language is taken, of each text stretches spread over the whole of it. As labels can
    be wrong, automata of each half of it judge the other half, and the stretches they give to another
    language are left out.
    """
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang")).where((remainder(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull())
    known = known.withColumn("order", F.xxhash64("doc_id"))
    many = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not many:
        return build({})
    large = sorted(k for k, n in many.items() if n > TRAIN_DOCS)
    chosen = known.where(~F.col("lang").isin(large))  # languages with few texts: all of them
    for name in large:
        chosen = chosen.unionAll(known.where(F.col("lang") == name).orderBy("order", "doc_id").limit(TRAIN_DOCS))
    even = GATHER * TRAIN_SYMBOLS // len(many)
    most = {k: max(-(-even // min(n, TRAIN_DOCS)), STRETCH) for k, n in many.items()}

    def run(batch):
        taken = [stretches(letters_of(t), most[lang], (order >> 2 & 0xFFFF) / 0x10000) for lang, order, t in zip(*(batch[c].to_pylist() for c in ("lang", "order", "text")))]
        return pa.record_batch([batch["lang"], batch["order"], batch["doc_id"], pa.array([[x.tobytes() for x in t] for t in taken], pa.list_(pa.binary()))], ["lang", "order", "doc_id", "parts"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("lang", "order", "doc_id", "text")
    rows = rows.mapInArrow(by_batch(run), "lang string, order long, doc_id long, parts array<binary>")
    halves: list[dict[str, list[np.ndarray]]] = [{}, {}]
    for row in rows.orderBy("order", "doc_id").toLocalIterator():
        parts = [p for p in (np.frombuffer(x, np.uint32) for x in row["parts"]) if p.any()]
        if parts:
            halves[(row["order"] >> 1) & 1].setdefault(row["lang"], []).extend(parts)
    return clean_build(halves)


def clean_build(halves: list[dict[str, list[np.ndarray]]]) -> Model:
    """Automata of both halves without the stretches that automata of the other half give to another language; twice, the judges being cleaner then."""
    cut = halves
    for _ in range(2):
        judges = [build(half) for half in cut]
        cut = [{lang: _agreed(parts, lang, judge) for lang, parts in half.items()} for half, judge in zip(cut, judges[::-1])]
    names = sorted(set(cut[0]) | set(cut[1]))
    return build({lang: [p for half in cut for p in half.get(lang, [])] for lang in names})


def _agreed(parts: list[np.ndarray], lang: str, judge: Model) -> list[np.ndarray]:
    if lang not in judge.languages or len(judge.languages) < 2:
        return parts
    found = phrases([symbols_in(p, judge.classes, judge.symbol) for p in parts], judge) * judge.price
    return [p for p, f in zip(parts, found) if judge.languages[int(f.argmin())] == lang] or parts


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score (0 to 1): one row per row, whole texts; other columns are not read.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no language was
    learned. Equal phrase counts go to the language first in name order. A null doc_id is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        names, sure = predict(batch["text"].to_pylist(), shared.value)
        return pa.record_batch([batch["doc_id"], pa.array(names, pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(by_batch(run), "doc_id long, lang_pred string, score double")
