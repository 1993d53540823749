"""Scanners and kernels against loops that spell out what they compute."""

import random

import numpy as np
import pytest

from wardlake.llm import secretscan, simhash, toxicity

VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")


def same(a: str, b: str) -> bool:
    """Equal but for the case of A-Z."""
    return len(a) == len(b) and all(x == y or x.isascii() and y.isascii() and x.lower() == y.lower() for x, y in zip(a, b))


def assigned(text: str, at: int) -> tuple[int, int] | None:
    """(end of the match, length of the value) of an assignment that begins there."""
    for name in NAMES:
        if not same(text[at : at + len(name)], name):
            continue
        i = at + len(name)
        i += text[i : i + 1] in ("'", '"')
        while text[i : i + 1] == " ":
            i += 1
        if text[i : i + 1] not in (":", "="):
            continue
        i += 1
        while text[i : i + 1] == " ":
            i += 1
        i += text[i : i + 1] in ("'", '"')
        first = i
        while i < len(text) and text[i] in VALUE:
            i += 1
        if i > first:
            return i, i - first
    return None


def plain_scan(text: str) -> list[tuple[int, int, int]]:
    out, at = [], 0
    while at < len(text):
        hit = assigned(text, at)
        if hit and hit[1] >= 6:
            out.append((at, 0, hit[0]))
        at = hit[0] if hit else at + 1
    at = 0
    while at < len(text):
        end = at + 4
        while text[at : at + 4] == "AKIA" and end < len(text) and (text[end].isascii() and text[end].isupper() or text[end] in "0123456789"):
            end += 1
        if text[at : at + 4] == "AKIA" and end > at + 4:
            if end - at >= 20:
                out.append((at, 1, end))
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in "0123456789abcdef":
            end += 1
        if end - at >= 24:
            out.append((at, 2, end))
        at = max(end, at + 1)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_against_a_plain_loop(seed):
    rng = random.Random(seed)
    pieces = [*NAMES, "PassWord", "APIKEY", "Api_Key", "toKen", "ſecret", "toKen", "=", " = ", ":", "'", '"', " ", "   ", "\t", "\n", "abc", "hunter2", "x" * 7, "AKIA", "AKIA" + "Z9" * 8, "AKIA" + "Q" * 15,
              "0123456789abcdef" * 2, "deadbeef" * 3, "deadbeef" * 2, "DEADBEEF" * 4, "é", "中", "\U0001f600", "-", "/", "==", "%", "\\"]
    seen = [0, 0, 0]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(12)))
        want = plain_scan(text)
        base, every = secretscan.secrets(text)
        assert base == want, text
        assert set(base) <= set(every), text
        for _, kind, _ in want:
            seen[kind] += 1
    assert min(seen) > 100


@pytest.mark.parametrize("seed", range(3))
def test_folded_weights_against_the_sum_over_gapped_triples(seed):
    """A stretch's score is the sum over all gapped triples that begin in it of weight times decay."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=toxicity.TRIPLES).astype(np.float32)
    text = "".join(rng.choice(list("abc xyz.!1é"), size=int(rng.integers(0, 400))))
    s = toxicity.symbols_of(text)
    begins = len(s) - toxicity.REACH
    plain = np.zeros(begins)
    for i in range(begins):
        for a, b in toxicity.GAPS:
            x, y, z = int(s[i]), int(s[i + a]), int(s[i + a + b])
            plain[i] += toxicity.DECAY ** (a + b - 2) * float(weights[(x * toxicity.SIZE + y) * toxicity.SIZE + z])
    got = toxicity.position_scores(s, weights)
    assert np.allclose(got, plain, atol=1e-3)
    sums = [plain[i : i + toxicity.WINDOW].sum() for i in range(max(1, begins - toxicity.WINDOW + 1))]
    assert np.allclose(toxicity.window_sums(got), sums, atol=1e-2)


def test_short_texts_that_are_similar_are_all_met(spark):
    """At exactly 0.8 and above, texts of up to 13 words: the groups are those of all pairs compared."""
    rng = random.Random(4)
    texts = [None, "", "one two"]
    for _ in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 14))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            cut = rng.random()
            near = words[:-1] if cut < 0.3 else words[1:] if cut < 0.6 else [*words[:-1], f"x{rng.randrange(10**6)}"] if cut < 0.9 else [*words, "more"]
            texts.append(" ".join(near))
    stem = [f"s{i}" for i in range(12)]
    texts += [" ".join([*stem, f"end{i}"]) for i in range(200)]  # all share one key, and are one group
    sets = [set(simhash.word_shingles((t or "").encode(), 5)) for t in texts]
    least = list(range(len(texts)))
    def top(i):
        while least[i] != i:
            i = least[i]
        return i
    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                least[b] = a
                linked += len(sets[i]) <= simhash.SHORT and both > 0 and sets[i] != sets[j]
    assert linked > 19_900
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(simhash.similar_groups(docs).collect()) == {i: top(i) for i in range(len(texts))}
