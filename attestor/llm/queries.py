"""The registered queries of the subpackage: name, Spark job over the whole table, DuckDB statement where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import audit, jaccard, language, licences, lm, manifest, packing, quality, sentencepieces, squares, toxicity, vectors, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(run):
    QUERIES[run.__name__] = run
    return run


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


@query
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.compare(table(spark, folder, "documents"))


@query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents")).drop("notices")


@query
def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes_of(table(spark, folder, "documents"))


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op8_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query
def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.encode(table(spark, folder, "documents"), with_ids=False)


@query
def op10_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_corpus(table(spark, folder, "documents"))


@query
def op11_squares(spark: SparkSession, folder: str) -> DataFrame:
    return squares.pack(table(spark, folder, "documents"))


@query
def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify(table(spark, folder, "documents"))


@query
def op13_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.steps(table(spark, folder, "documents"), table(spark, folder, "labels"))


oracle("op6_jaccard", """
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM words
), tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON s.doc_id = r.a
""")

oracle("op8_near_vectors", """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM embeddings v JOIN least r ON r.a = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
""")

# Rounds of a group's tree run in one recursive step a level; crc32 of the decimal doc_id is folded over its bytes with a table made from the polynomial.
oracle("op12_manifest", """
WITH RECURSIVE crc AS MATERIALIZED (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
), docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, lang, n_chars, coalesce(CAST(strlen(CAST(doc_id AS VARCHAR)) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(CAST(strlen(source) AS VARCHAR) || ':' || source, '-')
               || coalesce(CAST(strlen(lang) AS VARCHAR) || ':' || lang, '-') AS head, coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-') AS tail,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 7 = 0 AS hit
    FROM documents CROSS JOIN crc
), leaves AS MATERIALIZED (
    SELECT r, doc_id, lang, sha256(head || coalesce(CAST(strlen(CAST(n_chars AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR), '-') || tail) AS leaf,
           CASE WHEN hit AND n_chars IS NOT NULL THEN sha256(head || CAST(strlen(CAST(n_chars + 1 AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars + 1 AS VARCHAR) || tail) END AS tampered
    FROM docs
), ranked AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree(grp, level, p, n, node) AS (
    SELECT coalesce('1' || lang, '0'), 0, p, n, leaf FROM ranked
    UNION ALL
    SELECT grp, level + 1, p // 2, (n + 1) // 2, sha256(node || coalesce(other, '')) FROM (SELECT *, lead(node) OVER (PARTITION BY grp ORDER BY p) AS other FROM tree) WHERE n > 1 AND p % 2 = 0
), kept AS MATERIALIZED (SELECT * FROM tree),
tops AS MATERIALIZED (SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS p, count(*) OVER () AS n FROM kept WHERE n = 1),
top(level, p, n, node) AS (
    SELECT 0, p, n, node FROM tops
    UNION ALL
    SELECT level + 1, p // 2, (n + 1) // 2, sha256(node || coalesce(other, '')) FROM (SELECT *, lead(node) OVER (ORDER BY p) AS other FROM top) WHERE n > 1 AND p % 2 = 0
), above AS MATERIALIZED (SELECT * FROM top),
steps AS MATERIALIZED (
    SELECT d.r, k.level, s.node AS other, (d.p >> k.level) % 2 = 1 AS is_left
    FROM ranked d JOIN (SELECT DISTINCT grp, level, n FROM kept WHERE n > 1) k ON k.grp = coalesce('1' || d.lang, '0')
    LEFT JOIN kept s ON s.grp = k.grp AND s.level = k.level AND s.p = xor(d.p >> k.level, 1)
    UNION ALL
    SELECT d.r, 1000 + k.level, s.node, (t.p >> k.level) % 2 = 1
    FROM ranked d JOIN tops t ON t.grp = coalesce('1' || d.lang, '0') CROSS JOIN (SELECT DISTINCT level, n FROM above WHERE n > 1) k LEFT JOIN above s ON s.level = k.level AND s.p = xor(t.p >> k.level, 1)
), numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS k FROM steps),
proofs AS (SELECT r, sha256(coalesce(string_agg(other, '' ORDER BY k), '')) AS proof FROM numbered GROUP BY r),
folding(r, k, node) AS (
    SELECT r, 0, coalesce(tampered, leaf) FROM ranked
    UNION ALL
    SELECT f.r, f.k + 1, sha256(CASE WHEN s.is_left THEN s.other || f.node ELSE f.node || coalesce(s.other, '') END) FROM folding f JOIN numbered s ON s.r = f.r AND s.k = f.k + 1
), folded AS (SELECT r, max_by(node, k) AS node FROM folding GROUP BY r)
SELECT d.doc_id, d.leaf, t.node AS subroot, a.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = a.node AS verified
FROM ranked d JOIN tops t ON t.grp = coalesce('1' || d.lang, '0') CROSS JOIN (SELECT node FROM above WHERE n = 1) a JOIN folded f ON f.r = d.r LEFT JOIN proofs p ON p.r = d.r
""")

oracle("op13_audit", """
WITH RECURSIVE letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
texts AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM texts),
least AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masks AS MATERIALIZED (
    SELECT part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(words.text, '[^A-Z]', '', 'g')) > 5 * length(words.text) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(words.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN words.doc_id > first_id THEN 16 ELSE 0 END AS mask,
           count(*) AS docs, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM words JOIN least ON least.text = words.text LEFT JOIN said ON said.doc_id = words.doc_id GROUP BY ALL
), orders(o, used, step) AS (
    SELECT '', 0, 0 UNION ALL SELECT o || f, used + bit, step + 1 FROM orders JOIN letters ON used & bit = 0
), places AS (SELECT s.o AS filter_order, s.step, s.used - l.bit AS before, l.bit, l.f FROM (SELECT a.o, b.step, b.used, b.o AS head FROM orders a JOIN orders b ON a.step = 5 AND b.step > 0 AND starts_with(a.o, b.o)) s JOIN letters l ON l.f = right(s.head, 1)),
found AS (
    SELECT part, filter_order, step, f, coalesce(sum(docs) FILTER (mask & (before + bit) = 0), 0) AS kept, coalesce(sum(docs) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
           coalesce(sum(docs) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(docs) FILTER (mask = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
    FROM masks CROSS JOIN places GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM found
""")
