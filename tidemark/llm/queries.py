"""The registered queries of this subpackage and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, embedding, extraction, license, lines, lm, mixing, quality, sharding, simhash
from tidemark.llm.common import table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path; source, language and id stand for one."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return license.license_scan(files).select("doc_id", "path", "license", "license_score", "license_basis", "license_dir")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embedding_links(table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_license_scan, op4_simhash, op5_bpe, op6_embedding, op7_html_extraction, op8_sharding, op9_lm_scoring, op10_line_dedup)}

OP1_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT r, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') AS win FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM rep) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT y) AS n FROM (SELECT r, unnest(string_split(x, chr(10))) AS y FROM t) WHERE regexp_matches(y, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, w.x, ws, len(ws) AS n_words,
  length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  length(x) - length(replace(x, '!', '')) AS bangs,
  len(list_filter(ws, lambda s: strlen(s) > 1 AND regexp_matches(s, '[A-Z]') AND NOT regexp_matches(s, '[a-z]'))) AS caps,
  length(x) - length(replace(x, chr(10), '')) + 1 AS n_lines
 FROM w LEFT JOIN l USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
 n_repeat_words::BIGINT AS n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > 0.3 * n_words OR bangs > 0.3 * n_words OR 2 * caps > n_words
      OR (2 * n_dup_lines > n_lines AND n_dup_lines > 2)) AS kept
FROM m"""

OP10_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS y, generate_subscripts(ls, 1) AS i FROM t),
k AS (SELECT r, doc_id, i, y, translate(trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
e AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
j AS (SELECT r, k.doc_id, i, y, e.key IS NOT NULL AND k.doc_id <> e.last AS gone FROM k LEFT JOIN e USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
 sha256(coalesce(string_agg(y, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id"""

OP6_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN r ON r.a = v.vec_id GROUP BY v.vec_id"""



def _op3_sql() -> str:
    """The plain product: every text and part of one against every template, then the nearest directory."""
    idf, other, vectors = license.weights(license.TEMPLATES)
    rows = ", ".join(f"({k}, '{name}', '{t}', {idf[t]!r}::DOUBLE, {w!r}::DOUBLE)" for k, (name, v) in enumerate(vectors) for t, w in sorted(v.items()))
    marked = " OR ".join(f"contains(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{m}')" for m in license.MARKERS)
    return rf"""
WITH tpl(k, license, term, idf, w) AS (VALUES {rows}), idfs AS (SELECT DISTINCT term, idf FROM tpl),
f AS (SELECT doc_id, source || '/' || lang AS dir, source || '/' || lang || '/' || doc_id AS path, text FROM documents),
named AS (SELECT doc_id, regexp_matches(path, '{license.FILE_NAME}') AS named FROM f),
parts AS (SELECT doc_id, 2 AS kind, string_split_regex(text, '\n[ \t\r]*\n') AS ps FROM f UNION ALL SELECT doc_id, 3, string_split(text, chr(10)) FROM f UNION ALL SELECT doc_id, 4, string_split_regex(text, '[.;][ \t]+|\n') FROM f),
u AS (SELECT * FROM (SELECT doc_id, kind, unnest(ps) AS body, generate_subscripts(ps, 1) AS pos FROM parts UNION ALL SELECT doc_id, 0, text, 1 FROM f) WHERE {marked}),
t AS (SELECT doc_id, kind, pos, term, count(*) AS n FROM (SELECT doc_id, kind, pos, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{license.TERM}')) AS term FROM u) GROUP BY ALL),
x AS (SELECT doc_id, kind, pos, term, n * coalesce(idf, {other!r}::DOUBLE) AS x FROM t LEFT JOIN idfs USING (term)),
nrm AS (SELECT doc_id, kind, pos, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
s AS (SELECT x.doc_id, x.kind, x.pos, k, license, sum(x.x * tpl.w) / any_value(norm) AS score FROM x JOIN tpl USING (term) JOIN nrm USING (doc_id, kind, pos) GROUP BY ALL HAVING sum(x.x * tpl.w) / any_value(norm) >= 0.8),
b AS (SELECT doc_id, kind, pos, license, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, kind, pos ORDER BY score DESC, k) = 1),
p AS (SELECT doc_id, license, score FROM (SELECT * FROM b WHERE kind > 0 UNION ALL SELECT doc_id, 1, 0, regexp_extract(text, '{license.TAG}', 1), 1.0 FROM f WHERE regexp_matches(text, '{license.TAG}')) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind, pos) = 1),
w AS (SELECT doc_id, license, score FROM (SELECT doc_id, 0 AS t, license, score FROM b WHERE kind = 0 UNION ALL SELECT doc_id, 1, license, score FROM p JOIN named USING (doc_id) WHERE named) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t) = 1),
h AS (SELECT doc_id, license, score FROM p),
d AS (SELECT dir, license FROM w JOIN f USING (doc_id) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1)
SELECT f.doc_id, path, coalesce(w.license, h.license, d.license) AS license, coalesce(w.score, h.score) AS license_score,
 CASE WHEN w.license IS NOT NULL THEN 'file' WHEN h.license IS NOT NULL THEN 'header' WHEN d.license IS NOT NULL THEN 'inherited' END AS license_basis,
 CASE WHEN w.license IS NULL AND h.license IS NULL AND d.license IS NOT NULL THEN f.dir END AS license_dir
FROM f LEFT JOIN w USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN d USING (dir)"""


ORACLE_SQL = {"op3_license_scan": _op3_sql(), "op6_embedding": OP6_SQL, "op1_quality_rules": OP1_SQL, "op10_line_dedup": OP10_SQL}
