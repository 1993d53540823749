"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import bpe, decontam, divergence, itq, langid, linededup, manifest, mixing, pareto, secretscan, simhash, toxicity, warc
from wardlake.llm.common import Scratch, remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at 3 bits or fewer."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before dropping, lines dropped and the digest of what stays, of every document."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), repeated AS (
    SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.last AS dropped FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document and in the layers hidden in it."""
    return secretscan.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it stays, of every vector; links at a cosine of 0.98 or more within a label."""
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op3_embedding_dedup"] = r"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
), reach(vec_id, met) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN linked l ON l.a = r.met
)
SELECT e.vec_id, (SELECT count(*) FROM linked WHERE a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(met) AS component_id FROM reach GROUP BY vec_id) c ON e.vec_id = c.vec_id
"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document holds a benchmark item, which ones, and the highest similarity."""
    out = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.col("hits.item").alias("item_ids"), F.coalesce(F.array_max("hits.similarity"), F.lit(0.0)).alias("similarity"))


@query
def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record with its place, hash and state in a second replica that has known damage."""
    scratch = Scratch(spark)
    first, second = warc.page_replicas(table(spark, sf_dir, "pages"), scratch)
    found = warc.audit(first, second, scratch)
    named = first.select("page_id", F.col("file").alias("f"), F.col("offset").alias("o"))
    return named.join(found, (F.col("f") == F.col("file")) & (F.col("o") == F.col("offset"))).select("page_id", "file", "offset", "length", "hash", "status")


ORACLES["op6_warc_fixity"] = r"""
WITH named AS (
    SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
        CASE WHEN page_id % 50 = 7 AND length(html) > 0 THEN left(html, length(html) - 1) || '~' ELSE coalesce(html, '') END AS hurt, md5(page_id || '|' || coalesce(url, '')) AS m
    FROM pages
), framed AS (
    SELECT page_id, html, hurt, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
        || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
        || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap
    FROM named
), records AS (
    SELECT page_id, head || strlen(html) || gap || html || gap AS a, head || strlen(hurt) || gap || hurt || gap AS b FROM framed
), placed AS (
    SELECT page_id, page_id // 512 AS file, strlen(a) AS length, sha256(a) AS hash, sha256(b) AS other FROM records
)
SELECT page_id, file, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length, hash,
    CASE WHEN page_id % 97 = 3 THEN 'missing' WHEN hash <> other THEN 'corrupt' ELSE 'ok' END AS status
FROM placed
"""


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and mixed-context score of every document."""
    return mixing.score(table(spark, sf_dir, "documents"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of term shares between the sources of a language, and the terms that mark a source."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
    FROM documents
), terms AS (
    SELECT row, lang, source, unnest(found) AS term FROM docs
), kept AS (
    SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term
), dense AS (
    SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), shares AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p FROM dense WINDOW g AS (PARTITION BY lang, source)
), whole AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER g + 5 * count(*) OVER g) AS q FROM dense GROUP BY lang, term WINDOW g AS (PARTITION BY lang)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.term = y.term WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), marks AS (
    SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
    FROM (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term' AS part, * FROM marks)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix by source weights takes."""
    return pareto.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and check of every document; every second one has lost its line ends since the manifest was made."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(remainder(docs["doc_id"], 2) == 0, F.translate(docs["text"], "\n", "")).otherwise(docs["text"])
    return manifest.manifest(docs, tampered).drop("source")


ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE fields AS (
    SELECT doc_id, source, lang, n_chars, text,
        list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_prepend(ascii(c)::BIGINT, list_value(-1, -1, -1, -1, -1, -1, -1)::BIGINT[])))),
            lambda crc, e: xor(xor(crc, greatest(e, 0)) >> 1, 3988292384 * (xor(crc, greatest(e, 0)) & 1))) AS crc
    FROM documents
), framed AS (
    SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        CASE WHEN crc % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS found
    FROM fields
), leaves AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
        sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS found
    FROM framed
), nodes(tree, level, pos, n, hash) AS (
    SELECT tree, 0, pos, n, leaf FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3
), subroots AS (
    SELECT tree, level, hash FROM nodes WHERE n = 1
), upper_nodes(level, pos, n, hash) AS (
    SELECT 0, tree, (SELECT count(*) FROM subroots), hash FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 3
), runs AS (
    SELECT tree, level, pos, coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, pos // 3 ORDER BY pos)
), upper_runs AS (
    SELECT level, pos, coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM upper_nodes WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 3 ORDER BY pos)
), steps AS (
    SELECT f.tree, f.pos, r.level, r.l, r.r FROM leaves f JOIN runs r ON f.tree = r.tree AND r.pos = f.pos // (3 ** r.level)::BIGINT
    UNION ALL
    SELECT f.tree, f.pos, s.level + u.level, u.l, u.r FROM leaves f JOIN subroots s ON f.tree = s.tree JOIN upper_runs u ON u.pos = f.tree // (3 ** u.level)::BIGINT
), listed AS (
    SELECT tree, pos, list({'l': l, 'r': r} ORDER BY level) AS path FROM steps GROUP BY tree, pos
), folded(tree, pos, i, h) AS (
    SELECT tree, pos, 0, found FROM leaves
    UNION ALL
    SELECT f.tree, f.pos, i + 1, sha256(p.path[i + 1].l || h || p.path[i + 1].r) FROM folded f JOIN listed p ON f.tree = p.tree AND f.pos = p.pos WHERE i < len(p.path)
)
SELECT f.doc_id, f.leaf, s.hash AS subroot, t.hash AS root, sha256(coalesce(array_to_string(list_transform(p.path, lambda e: e.l || e.r), ''), '')) AS proof_sha256, g.h AS folded_root, g.h = t.hash AS verified
FROM leaves f JOIN subroots s ON f.tree = s.tree JOIN (SELECT hash FROM upper_nodes WHERE n = 1) t ON true LEFT JOIN listed p ON f.tree = p.tree AND f.pos = p.pos
JOIN folded g ON f.tree = g.tree AND f.pos = g.pos AND g.i = coalesce(len(p.path), 0)
"""
