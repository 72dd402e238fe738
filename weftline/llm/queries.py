"""The corpus queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, embeddings, langid, licenses, mixing, passages, pii, quality, resampling, simhash, toxicity, urls
from ._shared import table


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(spark)).select("doc_id", "pii.*")


def op3_url_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op7_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents"))


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit_text(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), model)


def vocabulary(path: str | None = None) -> bpe.Vocabulary:
    return bpe.Vocabulary.load(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary(), ["doc_id"])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(table(spark, sf_dir, "documents"))


def op13_toxicity_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_quality_outliers": op1_quality_outliers,
    "op2_pii_boosting": op2_pii_boosting,
    "op3_url_boosting": op3_url_boosting,
    "op4_vector_links": op4_vector_links,
    "op5_source_mixing": op5_source_mixing,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_shared_passages": op7_shared_passages,
    "op8_language_fusion": op8_language_fusion,
    "op9_bpe_roundtrip": op9_bpe_roundtrip,
    "op10_license_scan": op10_license_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_divergence_audit": op12_divergence_audit,
    "op13_toxicity_boosting": op13_toxicity_boosting,
}

#: DuckDB SQL where it can express the whole result. The CRC-32 of a word goes over the bytes of its hexadecimal form.
OP11_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
texts AS (SELECT 0 AS k, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
w AS (SELECT k, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
h AS (SELECT w, hex(w) AS x FROM (SELECT DISTINCT w FROM w)),
c AS (SELECT w, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM h, tab),
n AS (SELECT b, count(*) FILTER (WHERE k = 0) AS s, count(*) FILTER (WHERE k = 1) AS t FROM w JOIN c USING (w) GROUP BY b),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
g AS (SELECT b, CAST(floor(1000 * ln(CAST(n.t + 1 AS DOUBLE) * CAST(z.s + 10000 AS DOUBLE) / (CAST(n.s + 1 AS DOUBLE) * CAST(z.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n, z),
d AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN c USING (w) JOIN g USING (b) WHERE k = 0 GROUP BY r),
e AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM texts LEFT JOIN d USING (r) WHERE k = 0),
f AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM f)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM o
"""
OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM docs),
kept AS (SELECT lang, w FROM w GROUP BY lang, w HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM docs),
n AS (SELECT lang, source, w, count(*) AS n FROM w JOIN kept USING (lang, w) GROUP BY ALL),
cell AS (SELECT lang, source, w, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, w)),
gp AS (SELECT lang, source, w, n, 1 + (1000000000 * (n::HUGEINT + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) AS p FROM cell JOIN v USING (lang)),
lq AS (SELECT lang, w, 1 + (1000000000 * (sum(n)::HUGEINT + 5)) // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + 5 * any_value(v)) AS q FROM cell JOIN v USING (lang) GROUP BY lang, w),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value, 'pair' AS part FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, w AS item, p - q AS value, 'term' AS part FROM gp JOIN lq USING (lang, w) WHERE n > 0 AND p > q),
every AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM every WHERE part = 'pair' OR rank <= 50
"""
OP5_SQL = r"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM docs GROUP BY source),
total AS (SELECT sum(source_size) AS goal FROM s),
level AS (SELECT a.source, sum(least(3 * b.source_size * a.w, 3 * a.source_size * b.w)) AS words FROM s a, s b GROUP BY a.source),
f AS (SELECT s.source, source_size, w, words < goal * w AS is_full FROM s JOIN level ON s.source IS NOT DISTINCT FROM level.source, total),
rest AS (SELECT CAST(goal - coalesce((SELECT sum(3 * source_size) FROM f WHERE is_full), 0) AS DOUBLE) AS words, (SELECT sum(w) FROM f WHERE NOT is_full) AS w FROM total),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE words * f.w / CAST(rest.w AS DOUBLE) END AS target FROM f, rest),
e AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start FROM docs)
SELECT doc_id, size, source_size, target, CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken, p.source FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""
ORACLES: dict[str, str] = {"op5_source_mixing": OP5_SQL, "op11_importance_resampling": OP11_SQL, "op12_divergence_audit": OP12_SQL}
