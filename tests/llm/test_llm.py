"""Each operator against a brute-force version or a round trip, and its defined results for odd input."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import urllib.parse
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from wardlake.llm import bpe, decontam, itq, langid, linededup, mixing, secretscan, simhash, toxicity, warc
from wardlake.llm.common import Scratch
from wardlake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, node long"
WORDS = "amber birch cedar delta ember frost grove haven inlet jade knoll larch maple north ocean pearl quartz ridge stone tulip umber vale willow yarrow".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "some words here"), (5, "x " * 30_000), (6, "copy of a row"), (6, "copy of a row"), (7, "ÀÉ ß 中文 \x00 end")]


def odd(spark):
    return frame(spark, ODD)


def test_components_of_chains_stars_and_nothing(spark):
    scratch = Scratch(spark)
    pairs = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (5, 4), (5, 4)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long"), scratch).collect())
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 130)}, 4: 4, 5: 4}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_links_and_components(spark):
    rng = random.Random(4)
    rows, base = [], [prose(rng, 200) for _ in range(40)]
    for i in range(160):
        words = base[i % 40].split(" ")
        for _ in range(i // 40 * 2):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 - i, " ".join(words)))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert all(got[i]["fp"] & (2**64 - 1) == p for i, p in prints.items())
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: r["component_id"] for i, r in got.items()} == {i: root(i) for i in prints}
    assert 1 < len(set(map(root, prints))) < len(prints)


def test_thresholds_sum_and_cover_the_radius():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 300).astype(np.uint64)
    cells = [list(range(i * 16, i * 16 + 16)) for i in range(4)]
    counts = [np.bincount(simhash.cell_values(fps, c), minlength=1 << 16) for c in cells]
    for parts in ([[0], [1], [2], [3]], [[0, 1], [2, 3]]):
        for radius in (3, 7):
            layout = simhash.Layout(cells, parts, np.stack([simhash.rings(c, radius) for c in counts]), len(fps))
            got = simhash.thresholds(fps, layout, radius)
            assert (got.sum(1) == radius + 1).all()
            for _ in range(50):
                i = rng.integers(len(fps))
                other = int(fps[i])
                for bit in rng.permutation(64)[:radius]:
                    other ^= 1 << int(bit)
                keys, near = (simhash.part_keys(np.array([f], np.uint64), layout) for f in (fps[i], other))
                assert any(int(a[0] ^ b[0]).bit_count() < got[i, p] for p, (a, b) in enumerate(zip(keys, near)))


def test_similar_groups_follow_the_texts(spark):
    rng = random.Random(8)
    rows = []
    for g in range(30):
        words = prose(rng, 150).split(" ")
        rows.append((g * 10, " ".join(words)))
        for c in range(3):
            near = list(words)
            near[rng.randrange(150)] = "changed"
            rows.append((g * 10 + 1 + c, " ".join(near)))
        rows.append((g * 10 + 9, " ".join(words[:60]) + " " + prose(rng, 90)))
    got = dict(simhash.similar_groups(frame(spark, [*rows, (None, "lost"), (5000, None), (5001, " ")])).collect())
    for g in range(30):
        assert [got[g * 10 + c] for c in range(4)] == [g * 10] * 4 and got[g * 10 + 9] == g * 10 + 9
    assert got[5000] == got[5001] == 5000 and None not in got
    assert simhash.similar_groups(frame(spark, [])).count() == 0


def test_parities_never_part_similar_sets(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for i in range(400):
        whole = rng.integers(0, 2**63, 2000).astype(np.uint64)
        n, gone, new = (int(rng.integers(1, m)) for m in (1500, 60, 60))
        a, b = whole[:n], np.concatenate([whole[min(gone, n - 1) : n], whole[1900 : 1900 + new]])
        rows.append((i, len(a), *simhash.parities(a).tolist(), len(b), *simhash.parities(b).tolist()))
        both = len(np.intersect1d(a, b))
        want.append(both / (len(a) + len(b) - both))
    names = ["i", *[f"{p}{c}" for p in ("x_", "y_") for c in simhash.SKETCHED]]
    pairs = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))
    kept = {r["i"] for r in pairs.where(simhash.may_be_similar(0.8, "x_", "y_")).collect()}
    assert kept >= {i for i, j in enumerate(want) if j >= 0.8}
    assert not kept & {i for i, j in enumerate(want) if j < 0.6 and rows[i][1] < 300}


def test_similar_groups_of_a_family_of_unlike_texts(spark):
    """Members of one family with 0 to 11 words changed: groups are the components of the similar pairs, by brute force."""
    rng = random.Random(12)
    base = prose(rng, 150).split(" ")
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(12)):
            words[at] = f"new{rng.randrange(10**6)}"
        rows.append((500 - i, " ".join(words)))
    sets = {i: set(simhash.word_shingles(t.encode(), 5)) for i, t in rows}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= 0.85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    got = dict(simhash.similar_groups(frame(spark, rows), similarity=0.85).collect())
    assert got == {i: root(i) for i in sets}
    assert len(set(got.values())) > 5


def test_bpe_equals_the_library_and_decodes(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    pool = list("abcdefgh'stllre  \n\t\r\x1c\x85\xa0éßñ中😀01²_-!") + ["<|endoftext|>", "'ll", " the", "aaaa"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(80)))) for i in range(400)] + [(1000, "a" * 9000), (1001, None), (1002, "ab" * 3000)]
    got = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, rows), path).collect()}
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(frame(spark, rows), path).collect()}
    back = dict(bpe.decode(bpe.encode(frame(spark, rows), path), path).collect())
    for i, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want and got[i]["n_tokens"] == len(want) and back[i] == (text or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 64))
    rows = [(i, [float(x) for x in base[i % 60] + rng.normal(size=64) * 0.04 * (i // 60)], i % 3) for i in range(300)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], None), (403, None, 1), (404, [0.0] * 64, 1), (405, [float("nan")] * 64, 1), (406, [1.0, 2.0], 1), (407, [1.0, None], 1), (None, rows[1][1], 1)]
    got = {r["vec_id"]: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    plain = [(i, np.array(v, np.float32).astype(float), k) for i, v, k in rows if v is not None and k is not None and None not in v and np.isfinite(v).all() and any(v)]
    want = {i: {j for j, w, m in plain if j != i and m == k and len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.98} for i, v, k in plain}
    links, found = sum(map(len, want.values())), sum(r["n_links"] for r in got.values())
    assert 0.9 * links <= found <= links
    for i in (402, 403, 404, 405, 406, 407):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[400]["component_id"] == got[401]["component_id"] == 0 and not got[None]["kept"]


def test_toxicity_finds_gapped_insults_and_leaves_clean_texts():
    rng = random.Random(9)
    texts = [prose(rng, 60) for _ in range(400)]
    for i in range(200):
        words = texts[i].split(" ")
        words[rng.randrange(60)] = rng.choice(["wretchface", "zugbrain"])
        texts[i] = " ".join(words)
    model = toxicity.fit(texts, [1] * 200 + [0] * 200)
    fresh = [prose(rng, 60) for _ in range(60)]
    hurt = [t + x + prose(rng, 20) for t, x in zip(fresh, [" wretchface ", " w.r.e.t.c.h.f.a.c.e ", " zug-brain "] * 20)]
    p = toxicity.probability(model, toxicity.margins([*hurt, *fresh, ""], model.weights, model.knee))
    assert (p[:60] >= 0.5).mean() >= 0.9 and (p[60:] < 0.5).mean() >= 0.95 and p[-1] < 0.5
    both = toxicity.margins([*hurt, "z" * 3_000_000], model.weights, model.knee)
    assert np.allclose(both[:-1], [toxicity.margin(t, model.weights, model.knee) for t in hurt], atol=1e-4)


def test_toxicity_sample_keeps_both_classes(spark):
    """One very long labelled text does not end the sample."""
    rng = random.Random(10)
    rows = [(i, prose(rng, 40) + " wretchface" * (i % 2)) for i in range(200)]
    order = {r["id"]: r["h"] for r in spark.range(200, 3000).selectExpr("id", "xxhash64(id) h", "crc32(cast(cast(id as string) as binary)) % 5 k").where("k <> 0").collect()}
    first = min(order, key=order.get)
    long = "word " * (toxicity.TRAIN_CHARS // 5 + 10)
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows] + [(first, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, [*rows, (first, long)]), labels)
    p = toxicity.probability(model, toxicity.margins([t for _, t in rows], model.weights, model.knee))
    assert ((p >= 0.5) == np.array([i % 2 for i, _ in rows])).mean() > 0.95
    assert toxicity.sampled([(1, 40), (0, 500), (0, 20), (1, 30), (0, 20)], 100) == [0, 2, 4]
    assert toxicity.sampled([(1, 900), (0, 10), (0, 80)], 100) == [0, 1]
    assert toxicity.sampled([(1, 10), (0, 80), (0, 30)], 100) == [0, 1]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    pool = [prose(rng, 3) for _ in range(12)] + ["short", "", "  " + "É" * 19, "É" * 20]
    rows = [(i, "\n".join(rng.choice([str.upper, str.title, lambda s: " " + s + "\t"])(rng.choice(pool)) if rng.random() < 0.7 else prose(rng, 4) for _ in range(8))) for i in range(60)]
    rows += [(70, None), (71, "")]

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = {k: max(d) for k, d in holders.items() if len(k) >= 20 and len(d) >= 3}
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert gone and linededup.dedup_lines(frame(spark, [])).count() == 0


def test_merkle_audit_names_the_damage(spark):
    rows = [(f, i * 1000, 900, hashlib.sha256(b"%d %d" % (f, i)).hexdigest()) for f in range(40) for i in range(200)]
    other = [r for r in rows if r[:2] != (3, 5000)]
    other = [(f, o, n, "changed" if (f, o) in {(7, 0), (39, 199000)} else h) for f, o, n, h in other] + [(90, 0, 5, "new")]
    schema = "file long, offset long, length long, hash string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    got = Counter((r["file"], r["offset"], r["status"]) for r in warc.audit(a, b).where("status <> 'ok'").collect())
    assert set(got) == {(3, 5000, "missing"), (7, 0, "corrupt"), (39, 199000, "corrupt"), (90, 0, "extra")}
    assert warc.audit(a, a).where("status = 'ok'").count() == len(rows)
    assert warc.audit(a.limit(0), b.limit(0)).count() == 0


def test_suffix_automaton_parses_into_fewest_phrases():
    rng = random.Random(5)
    text = [rng.randrange(2, 6) for _ in range(300)]
    model = langid.Model(["a"], np.zeros(0, np.uint32), np.zeros(0, np.int32), None, None)
    model = langid.build({"a": [np.array(text, np.uint32)], "b": [np.array(text[::-1], np.uint32)]})
    body = {lang: langid.symbols_in(np.array(t, np.uint32), model.classes, model.symbol).tolist() for lang, t in (("a", text), ("b", text[::-1]))}
    sample = [rng.randrange(2, 7) for _ in range(200)]
    symbols = langid.symbols_in(np.array(sample, np.uint32), model.classes, model.symbol)
    for k, lang in enumerate(model.languages):
        whole = ",".join(map(str, body[lang]))
        whole, n, i = f",{whole},", 0, 0
        while i < len(symbols):
            j = i + 1
            while j < len(symbols) and f",{','.join(map(str, symbols[i : j + 1]))}," in whole:
                j += 1
            n, i = n + 1, j
        assert langid.phrases([symbols], model)[0, k] == n


def test_language_of_held_out_texts(spark):
    rng = random.Random(3)
    sounds = {"en": ["the", "ing", "wh", "tion", "ed"], "de": ["sch", "ung", "keit", "ä", "ver"], "fr": ["eau", "ê", "ent", "que", "è"]}
    rows = [(i, " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(40)), lang, "s", None, None, None) for i in range(300) for lang, s in [list(sounds.items())[i % 3]]]
    rows += [(1000, None, "en", "s", None, None, None), (1001, "12 !?", None, "s", None, None, None), (1002, "", "de", "s", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows[:300]]) > 0.98
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))


def sounds_of(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(n))


def test_stray_languages_do_not_starve_the_large_ones(spark):
    rng = random.Random(23)
    sounds = {"en": ["ta", "ne", "is", "or"], "de": ["at", "en", "si", "ro"], "fr": ["te", "na", "os", "ir"]}
    rows = [(i, sounds_of(rng, s, 60), lang, "s", None, None, None) for i in range(300) for lang, s in [list(sounds.items())[i % 3]]]
    strays = [(1000 + i, rng.choice(["tane isor tane", "aten siro aten", "zu"]), f"stray{i}", "s", None, None, None) for i in range(20)]
    model = langid.train(docs := spark.createDataFrame(rows + strays, SCHEMA))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.98
    budgets = langid.budgets({"a": 10**6, "b": 10**6, "c": 30, **{f"s{i}": 200 for i in range(2000)}})
    assert budgets["c"] > 0 and budgets["a"] == budgets["b"] > 10_000 and sum(budgets.values()) <= langid.TRAIN_SYMBOLS


def test_languages_are_learned_from_whole_texts_and_many_of_them(spark):
    """What tells the languages apart comes late in long texts, and in each text other words of it."""
    rng = random.Random(29)
    same, words = ["la", "mo", "ke"], {k: [prose(rng, 1) for _ in range(60)] for k in ("en", "de")}
    rows = [(i, sounds_of(rng, same, 1200) + " " + " ".join(rng.choices(words[k], k=1200)), k, "s", None, None, None) for i in range(80) for k in [("en", "de")[i % 2]]]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    got, _ = langid.predict([" ".join(rng.choices(words[k], k=20)) for k in ("en", "de") * 20], model)
    assert np.mean([a == b for a, b in zip(got, ("en", "de") * 20)]) > 0.9


def test_decontamination_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, 20 + i)) for i in range(12)] + [(50, "three little words"), (51, ""), (52, None)]
    rows = []
    for i in range(60):
        words = items[i % 12][1].split(" ")
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "other"
        rows.append((i, prose(rng, i) + " " + (" ".join(words).upper() if i % 2 else " ".join(words)) + ", " + prose(rng, 10)))
    rows += [(100, prose(rng, 30) + " three little words"), (101, None), (102, items[0][1])]

    def brute(text):
        words, out = decontam.words_of(text), {}
        for item, t in items:
            mine = decontam.words_of(t)
            k = min(5, len(mine))
            for s in range(max(len(words) - len(mine), 0) + 1) if mine and words else ():
                window = words[s : s + len(mine)]
                a, b = (Counter(zip(*(w[i:] for i in range(min(k, len(w)))))) for w in (window, mine))
                found = (a & b).total() / (a | b).total()
                if found >= 0.8:
                    out[item] = max(out.get(item, 0), found)
        return out

    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (1 << 20, 700):  # in one part and in several
        got = {r["doc_id"]: {h["item"]: h["similarity"] for h in r["hits"]} for r in decontam.contamination(frame(spark, rows), bench, bound=bound).collect()}
        assert got == {i: brute(t) for i, t in rows}
    assert sum(map(bool, got.values())) > 20


def test_secrets_in_layers_and_plain_texts(spark):
    s = "password=hunter22abc"
    b64 = base64.b64encode(s.encode()).decode()
    cases = {
        "x " + s: "assign:2:22", "x " + urllib.parse.quote(s, safe=""): "assign:2:24", "x " + b64: f"assign:2:{len(b64.rstrip('=')) + 2}",
        "é " + base64.b64encode(b64.encode()).decode(): "assign:2:38", "x " + base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode(): "assign:2:58",
        "x " + "".join(f"\\u{ord(c):04x}" for c in s): "assign:2:122", "pass%77ord=abcdef": "assign:0:17", "secret = abc": "", "AKIA" + "Z" * 15: "", "AKIA" + "Z" * 16 + " " + "0" * 24: "access:0:20,hex:21:45", "": "",
    }
    got = {r["doc_id"]: r for r in secretscan.scan_secrets(frame(spark, [*enumerate(cases), (99, None)])).collect()}
    for i, (text, spans) in enumerate(cases.items()):
        assert got[i]["spans"] == spans, text
    assert got[0]["n_assign"] == 1 and got[2]["n_assign"] == 0 and got[99]["spans"] == ""
    assert got[0]["base_sha256"] == hashlib.sha256(b"assign:2:22").hexdigest()


def test_secrets_in_wrapped_glued_and_unprintable_layers():
    def spans(text):
        return [(s, e) for s, _, e in secretscan.secrets(text)[1]]

    s = "password=hunter22abcd"
    wrapped = base64.encodebytes(("z " * 49 + "," + s).encode()).decode().rstrip()
    assert len(wrapped.rsplit("\n", 1)[1]) < 16
    assert any(e == len(wrapped.rstrip("=")) for _, e in spans(wrapped)) and spans(wrapped) == [(x, y) for x, y in spans(wrapped + "\n\nhello")]
    b64 = base64.b64encode(s.encode()).decode()
    assert len(b64.rstrip("=")) == len(b64) == 28
    for head in ("https://host/cb/", "x-", "abc", "ab_", "/"):
        assert (len(head), len(head) + 28) in spans(head + b64), head
    assert spans(b64 + "\nhello") == [(0, 28)]
    for odd in (b"\xff\xfe", b"\xe4\xb8", "\u00a0\ufeff\u200b".encode(), b"\x1b[0m\x00"):
        code = base64.b64encode(odd + b" " + s.encode() + b" end").decode()
        first = (len(odd) + 1) // 3 * 4
        assert spans("x " + code) == [(2 + first, 2 + (len(odd) + len(s)) // 3 * 4 + 4)], odd
    packed = gzip.compress(b"nothing", mtime=0) + gzip.compress(s.encode(), mtime=0)
    for head in ("", "https://host/cb/"):
        assert spans(head + base64.b64encode(packed).decode())
    inner = base64.b64encode(b"q " * 60_000 + s.encode()).decode()
    block = b"- " * ((secretscan.BLOCK - 100_000) // 2) + inner.encode() + b" -"
    assert spans(base64.b64encode(gzip.compress(block, mtime=0)).decode())


def test_scores_against_brute_force(spark):
    import zlib

    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(40))) for i in range(120)] + [(500, None), (501, "")]
    got = {r["doc_id"]: r for r in mixing.score(frame(spark, rows)).collect()}
    tokens = {i: [*(t or "").lower().encode().split(), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = counts.total(), len(counts)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        assert r["score"] < 0


def test_bit_probabilities_of_all_bytes_sum_to_one():
    code = mixing.prefix_code(np.arange(256))
    model = mixing.fit([[b"some", b"words"]], np.zeros((mixing.SLOTS, 2), np.float32), code)
    total = 0.0
    for b in range(256):
        spelled = mixing.spell_bytes([bytes([b])], code, mixing.EVERY)
        stretch, gate = mixing.unfold(model.known[spelled.slots])
        total += math.exp(mixing.cost(mixing.mixed_by(stretch, gate, model.weights), spelled.bits, spelled.before, model.refine).sum())
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_codes_counts_and_weights_are_learned_from_all_training_documents(spark):
    from wardlake.llm.common import Scratch, texts

    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(9)) + f" zq{i}") for i in range(600)] + [(700, None), (701, "")]
    training = texts(frame(spark, rows)).repartition(3)
    code = mixing.letter_code(mixing.count_tokens(training))
    plain = Counter()
    for _, text in rows:
        for word in mixing.tokens((text or "").encode()):
            tail = (0, 0)
            for b in word + b" ":
                plain[tail, b] += 1
                tail = (tail[1], b)
    for p, q in ((0, 0), (0, ord("z")), (ord("z"), ord("q"))):
        at = code.rows[256 * p + q]
        assert at > 0
        one = mixing.prefix_code(np.array([plain[(p, q), b] for b in range(256)]))
        assert (code.sizes[at : at + 256] == one.sizes).all()
    spelled = mixing.spell([mixing.tokens((t or "").encode()) for _, t in rows], code)
    counts, lessons = mixing.learned(training, code, Scratch(spark))
    own = np.zeros((mixing.SLOTS, 2))
    for slots in spelled.slots:
        np.add.at(own, (slots, spelled.bits), 1)
    assert (counts == own).all()
    model = mixing.settle(counts, code, lessons)
    opened, hits = lessons[-256 * mixing.REFINE * 2 - mixing.GATES :][: mixing.GATES], lessons[-256 * mixing.REFINE * 2 :]
    assert opened.sum() == hits.sum() == len(spelled.bits)
    assert (model.weights != np.float32(0.4)).any()


def test_tokens_of_a_column_are_those_of_each_text():
    import pyarrow as pa

    rng = random.Random(13)
    odd_bytes = b" \t\n\x0b\x0c\r\x00\x1c\x1f\x85\xa0AZaz\xc3\xff"
    rows = [None, b"", b" ", b"A", "\u00c4B c\x85d".encode(), *(bytes(rng.choice(odd_bytes) for _ in range(rng.randrange(30))) for _ in range(2000))]
    column = pa.array([b"before", *rows], pa.binary()).slice(1)
    found = mixing.tokenised(column)
    assert found.flatten().cast(pa.binary()).to_pylist() == [w for r in rows for w in mixing.tokens(r)]
    assert found.value_lengths().fill_null(0).to_pylist() == [len(mixing.tokens(r)) for r in rows]
    assert [t for some in mixing.streams(column, found) for t in some] == [(i, b" ".join(mixing.tokens(r)) + b"\n") for i, r in enumerate(rows)]


def test_a_step_moves_each_weight_by_the_errors_under_its_gate():
    rng = np.random.default_rng(14)
    stretch, gate = rng.normal(size=(len(mixing.CONTEXTS), 500)).astype(np.float32), rng.integers(0, mixing.GATES, 500)
    bits, chance = rng.integers(0, 2, 500).astype(np.uint8), rng.random(500).astype(np.float32)
    weights = np.full((len(mixing.CONTEXTS), mixing.GATES), 0.4, np.float32)
    opened = mixing.learn(weights, stretch, gate, chance, bits, 0.1)
    for g in range(mixing.GATES):
        here = gate == g
        assert opened[g] == here.sum()
        for w, s in zip(weights, stretch):
            moved = 0.1 * ((bits[here] - chance[here]).astype(float) * s[here]).sum() / max(here.sum(), 1) ** 0.5
            assert math.isclose(w[g], 0.4 + moved, rel_tol=1e-5, abs_tol=1e-5)


def test_often_read_paths_of_a_code_lie_together():
    rng = np.random.default_rng(15)
    code = mixing.prefix_code(rng.integers(0, 1 << 20, (40, 256)) ** 3)
    order = np.argsort(code.starts)
    assert (np.diff(code.sizes[order]) >= 0).all() and (code.starts[order][1:] == np.cumsum(code.sizes[order])[:-1]).all()
    for row in range(0, 40, 13):
        paths = {tuple(code.turns[code.starts[c] : code.starts[c] + code.sizes[c]]) for c in range(256 * row, 256 * row + 256)}
        assert len(paths) == 256 and math.isclose(sum(0.5 ** len(p) for p in paths), 1)
        assert code.turns.itemsize == 2


def test_odd_rows_and_empty_tables(spark):
    docs, empty = odd(spark), frame(spark, [])
    path = public_tokenizers.path("byte_bpe_50k.json")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    model = toxicity.fit([], [])
    for run in (
        simhash.near_duplicates, lambda d: bpe.round_trip(d, path), linededup.dedup_lines, secretscan.scan_secrets, lambda d: decontam.contamination(d, bench), lambda d: decontam.contamination(d, bench.limit(0)),
        lambda d: toxicity.score(d, model), lambda d: toxicity.keep_clean(d, model), lambda d: langid.identify(d, langid.train(d)), mixing.score,
    ):
        assert run(docs).count() == len(ODD) and run(empty).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    clean = [(i, prose(rng, 50)) for i in range(40)]
    item = prose(rng, 30)
    rows = clean + [(100, clean[0][1]), (101, clean[1][1] + " more"), (200, prose(rng, 20) + " " + item)]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(40))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 40
