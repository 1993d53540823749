"""Source divergence, source mix and Merkle manifest against plain-Python versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardlake.llm import divergence, manifest, pareto

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, n long, hash string, tree long, class string, words long, term string, slot string, name string, part string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """rows of (doc_id, text, lang, source, n_chars); the other columns clash with names used inside."""
    return spark.createDataFrame([(*r, 1, 2, "h", 3, "c", 4, "t", "s", "n", "p") for r in rows], SCHEMA)


def rows_of_all_kinds(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "amber birch Cedar delta ÉMBER frost grove haven 中文 jade".split() for b in ("", "s", "ly", "q7", "É")]
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "fr", None])
        source = rng.choice(["a", "b", "b", "b", "ß", "z z", None, ""])
        text = " ".join(rng.choice(words[: rng.choice([5, 20, 50])]) for _ in range(rng.choice([0, 1, 5, 30, 200])))
        out.append((i, text.replace(" ", "\n", 3), lang, source, len(text)))
    out += [(n, None, "en", "a", None), (n + 1, "", None, None, 0), (None, "null id", "en", "b", 7), (None, "null id", "en", "b", 7), (3, out[3][1], out[3][2], out[3][3], out[3][4]), (-5, " \t\n-1, 2", "xx", "only", 1), (n + 2, "long " * 40_000, "fr", "b", 200_000)]
    return out


# ---- source divergence


def brute_divergence(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in {g for g, _ in counts}:
        kept = [t for t, c in docs[lang].items() if c >= min_docs]
        of = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        of[None] = {t: sum(c[t] for c in of.values()) for t in kept}
        p = {s: {t: 1 + 1_000_000_000 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()} for s, c in of.items()}
        for s in of:
            if s is None:
                continue
            pairs = [(sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in of if x not in (None, s)]
            marks = [(p[s][t] - p[None][t], t) for t in kept if of[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", marks, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda v: (-v[0], v[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence_against_brute_force(spark, monkeypatch, small):
    """With small shards, waves, tiles and blocks every way to split the work is taken."""
    if small:
        monkeypatch.setattr(divergence, "TILE", 8)
        monkeypatch.setattr(divergence, "SOURCES", 2)
    rows = rows_of_all_kinds(1, 300)
    limits = {"shard_terms": 7, "wave_bytes": 1500, "flush_bytes": 500} if small else {}
    got = divergence.divergence(frame(spark, rows), min_docs=9, top_terms=6, **limits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    want = brute_divergence(rows, 9, 6)
    assert set(got) == want and len(got) == len(want)
    assert {r[2] for r in want} == {"pair", "term"}


def test_divergence_without_terms_or_rows(spark):
    rows = [(1, "one two", "en", "a", 1), (2, None, "en", None, 1), (3, "", None, "b", 1)]
    got = {tuple(r) for r in divergence.divergence(frame(spark, rows)).collect()}
    assert got == {("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)}
    assert divergence.divergence(frame(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_knows_its_terms():
    for n in (0, 1, 2, 1000, 50_000):
        terms = [b"t%d" % (i * 7919) for i in range(n)]
        built = divergence.perfect_hash(terms)
        slots = built.slots(terms)
        assert sorted(slots) == list(range(n))
        assert [built.terms[int(s)].as_py() for s in slots[:50]] == terms[:50]
        assert (built.slots([b"x%d" % i for i in range(1000)]) == -1).all()


def test_shards_of_terms_are_spark_s(spark):
    terms = [b"", b"a", "é中".encode(), b"x" * 100, *(b"w%d" % i for i in range(50))]
    got = spark.createDataFrame(pa.table({"t": pa.array(terms, pa.binary())}).to_pandas(), "t binary").select(F.pmod(F.xxhash64("t"), F.lit(7)).alias("s"))
    assert [r["s"] for r in got.collect()] == divergence.shard_of(terms, 7).tolist()


def test_share_is_exact_for_large_counts(spark):
    cases = [(10**17, 3 * 10**17, 12345), (0, 0, 1), (7, 9, 2), (9_300_000_000, 9_300_000_001, 3)]
    got = spark.createDataFrame(cases, "c long, t long, v long").select(divergence.share(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (c + 5) // (t + 5 * v) for c, t, v in cases]


# ---- source mix


def brute_targets(words, weights=(5, 2, 1), most=3):
    order = sorted((s for s in words if s is not None)) + [s for s in words if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, out = sum(words.values()), set(order), {}
    while open_:
        rest = total - sum(out.values())
        level = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if level[s] > most * words[s]}
        if not above:
            return {**out, **level}
        out.update({s: most * words[s] for s in above})
        open_ -= above
    return out


def test_targets_against_repeated_resharing(spark):
    rng = random.Random(7)
    for n in (1, 2, 3, 8, 40):
        for _ in range(3):
            words = {None if i == 0 and n > 2 else f"s{i}": rng.choice([0, 1, 10, 1000, 10**6]) * rng.randrange(1, 9) for i in range(n)}
            got = pareto.targets(spark.createDataFrame(list(words.items()), "source string, words long")).collect()
            want = brute_targets(words)
            for r in got:
                assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
                if r["words"]:
                    assert r["whole"] == min(3, math.floor(round(want[r["source"]] / r["words"], 9)))


def test_mix_takes_the_first_of_each_class_and_meets_targets(spark):
    rows = [(i, " ".join(["w"] * s), "en", source, 0) for i, (s, source) in enumerate(
        (random.Random(i).choice([1, 3, 40, 41, 42, 43, 44, 200, 5000 if i % 90 == 0 else 7]), random.Random(-i).choice(["a", "b", "c", "c", "c", "c", None])) for i in range(1500))]
    docs = frame(spark, rows)
    got = pareto.mix(docs, bin_rows=8).collect()
    again = pareto.mix(docs.repartition(3), bin_rows=100_000).collect()
    key = lambda r: (r["doc_id"], str(r["source"]), r["copies"], r["taken"], r["target"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    words = Counter()
    for i, text, _, source, _ in rows:
        words[source] += len(text.split())
    want = brute_targets(words)
    ids = docs.select("doc_id", "source", F.regexp_count("text", F.lit(r"\w+")).cast("long").alias("size"))
    u = {r["doc_id"]: r["u"] for r in ids.select("doc_id", pareto.uniform(42, F.col("doc_id"), F.col("source"), F.col("size")).alias("u")).collect()}
    by_source = defaultdict(list)
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == words[r["source"]]
        by_source[r["source"]].append(r)
    for source, of in by_source.items():
        whole = min(3, math.floor(want[source] / words[source] + 1e-9))
        assert {r["copies"] - whole for r in of} <= {0, 1}
        assert abs(sum(r["taken"] for r in of) - want[source]) <= 0.01 * want[source] + 10
        classes = defaultdict(list)
        for r in of:
            classes[math.floor(math.log(r["size"]) / math.log(1.1))].append(r)
        for members in classes.values():
            members.sort(key=lambda r: u[r["doc_id"]] / (1 - u[r["doc_id"]]) / r["size"])
            taken = [r["copies"] > whole for r in members]
            assert taken == sorted(taken, reverse=True)


def test_mix_of_odd_rows_and_empty_tables(spark):
    rows = rows_of_all_kinds(2, 50)
    got = pareto.mix(frame(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    sizes = Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == sizes
    assert sum(r["target"] for r in {r["source"]: r for r in got}.values()) == pytest.approx(sum(n * c for (_, n), c in sizes.items()))
    blank = pareto.mix(frame(spark, [(1, None, "en", None, 0), (2, " ", "en", "a", 1)])).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in blank) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert pareto.mix(frame(spark, [])).count() == 0


# ---- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(hashes):
    """The root, and per leaf its path of (left, right)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for leaf, node in enumerate(at):
            run, slot = runs[node // 3], node % 3
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[leaf] = node // 3
        level = [sha("".join(run)) for run in runs]
    return level[0], paths


def brute_manifest(rows, change):
    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    of = defaultdict(list)
    for i, text, lang, source, n in rows:
        of[source].append((order(i), leaf((i, source, lang, n, text)), leaf((i, source, lang, n, change(i, text))), i))
    sources = sorted(of, key=order)
    trees = {s: brute_tree([h for _, h, _, _ in sorted(of[s])]) for s in sources}
    root, upper = brute_tree([trees[s][0] for s in sources])
    out = Counter()
    for s, above in zip(sources, upper):
        for (_, h, changed, i), path in zip(sorted(of[s]), trees[s][1]):
            path = path + above
            folded = changed
            for left, right in path:
                folded = sha(left + folded + right)
            out[i, h, trees[s][0], root, sha("".join(a + b for a, b in path)), folded, folded == root] += 1
    return out


@pytest.mark.parametrize("block", [manifest.BLOCK, 9])
def test_manifest_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(manifest, "BLOCK", block)
    rows = rows_of_all_kinds(3, 160)
    docs = frame(spark, rows)
    cut = F.when(F.col("doc_id") % 2 == 0, F.translate(docs["text"], "\n", "")).otherwise(docs["text"])
    got = manifest.manifest(docs, cut)
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got.collect())
    want = brute_manifest(rows, lambda i, t: t.replace("\n", "") if i is not None and i % 2 == 0 and t is not None else t)
    assert got == want
    assert {k[-1] for k in want} == {True, False}


def test_manifest_of_one_row_one_source_and_nothing(spark):
    for rows in ([(1, "a", "en", "s", 1)], [(2, None, None, None, None)], [(i, str(i), "en", None, i) for i in range(10)], [(i, "x", "en", f"s{i}", i) for i in range(4)]):
        got = manifest.manifest(frame(spark, rows)).collect()
        want = brute_manifest(rows, lambda i, t: t)
        assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got) == want
        assert all(r["verified"] for r in got)
    assert manifest.manifest(frame(spark, [])).count() == 0


def test_positions_of_a_hot_group(spark):
    rows = [("hot", (i * 7919) % 5000) for i in range(5000)] + [(None, 5), (None, None), ("a", 1)]
    from wardlake.llm.common import Scratch

    got = manifest.positions(spark.createDataFrame(rows, "g string, k long").repartition(6), ["g"], ["k"], Scratch(spark)).collect()
    assert sorted((r["pos"], r["k"], r["n"]) for r in got if r["g"] == "hot") == [(i, i, 5000) for i in range(5000)]
    assert sorted((r["pos"], r["k"] or -1) for r in got if r["g"] is None) == [(0, -1), (1, 5)]
