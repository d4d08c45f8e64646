"""The registered query of each operator: production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_url_rules as op1
from . import op02_automaton_bpe as op2
from . import op03_line_winnow as op3
from . import op04_vantage_trees as op4
from . import op05_rff_quality as op5
from . import op06_simhash_trie as op6
from . import op07_prefix_counts as op7
from . import op08_harmonic_packing as op8
from . import op09_gru_scoring as op9
from . import op10_quality_rules as op10
from . import op11_gnat_negatives as op11
from . import op12_voronoi_join as op12
from . import op13_importance_resampling as op13
from .common import read_table


#: The fixed rules of the url query.
URL_RULES = [
    op1.parse_rule("allow", "org/"),
    op1.parse_rule("block", "example.org/es/"),
    op1.parse_rule("block", "example.org/en/1"),
    op1.parse_rule("allow", "com/fr/"),
    op1.parse_rule("block", "com/de/"),
]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES, min_support=0.01, min_confidence=0.8)


def op2_automaton_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = op2.round_trip(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.dedup_lines(read_table(spark, sf_dir, "documents"), min_words=50)


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
n AS (
  SELECT *, row_number() OVER d AS r, sum(w) OVER (d ROWS UNBOUNDED PRECEDING) AS c
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l) WHERE w > 0
  WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
p AS (
  SELECT a.doc_id, a.r AS lo, b.r AS hi FROM n a JOIN n b
  ON a.doc_id = b.doc_id AND b.r >= a.r AND b.r < a.r + 50 AND b.c >= a.c - a.w + 50),
win AS (
  SELECT doc_id, lo, min(hi) AS hi FROM p GROUP BY doc_id, lo
  UNION
  SELECT doc_id, max(lo) AS lo, hi FROM p GROUP BY doc_id, hi),
runs AS (
  SELECT win.doc_id, lo, hi, string_agg(line, chr(10) ORDER BY r) AS run
  FROM win JOIN n ON n.doc_id = win.doc_id AND n.r BETWEEN lo AND hi GROUP BY ALL),
later AS (
  SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, lo) AS k FROM runs) WHERE k > 1),
gone AS (
  SELECT DISTINCT n.doc_id, n.pos FROM later JOIN n ON n.doc_id = later.doc_id AND n.r BETWEEN lo AND hi),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY l.doc_id),
changed AS (SELECT DISTINCT doc_id FROM gone)
SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, d.lang, d.source,
  CASE WHEN c.doc_id IS NULL THEN d.n_chars ELSE length(coalesce(k.text, '')) END AS n_chars
FROM documents d LEFT JOIN changed c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def op4_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


#: The search is exact at factor 1, so SQL states it.
OP4_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""


def op5_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op5.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = op6.simhash_groups(read_table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = op7.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


def op9_gru_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.score_documents(read_table(spark, sf_dir, "documents"), held_fold=(7, 2))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op10.judge_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_gnat_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op11.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, positives=5, negatives=5, window=(80, 100), scale=256.0, label=label)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 5
"""


def op12_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), max_run=1, n_buckets=10000, min_words=20, percent=10, seed="2024")


OP13_SQL = r"""
WITH RECURSIVE step(b, n, c) AS (
  SELECT CAST(range AS UBIGINT), 0, CAST(range AS UBIGINT) FROM range(256)
  UNION ALL
  SELECT b, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM step WHERE n < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM step WHERE n = 8),
w AS (
  SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT *, row_number() OVER () AS r FROM documents)),
aim AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f
  FROM benchmark),
flat AS (SELECT r, unnest(words) AS f FROM w),
per AS (SELECT r, f, count(*) AS n FROM flat GROUP BY r, f),
known AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM per UNION SELECT f FROM aim)),
hashed AS (
  SELECT f, CAST(xor(CAST(4294967295 AS UBIGINT), list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST('0x' || substr(h, i, 2) AS UBIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) % 10000 AS BIGINT) AS bucket
  FROM known, tab),
s AS (SELECT bucket, sum(n) AS s FROM per JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(
      (coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
      / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT r, sum(n * g) AS weight FROM per JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN weighed USING (r)),
ranked AS (
  SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= n * 10 // 100 THEN place END AS rank FROM ranked
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_rules": op1_url_rules,
    "op2_automaton_bpe": op2_automaton_bpe,
    "op3_line_winnow": op3_line_winnow,
    "op4_vantage_trees": op4_vantage_trees,
    "op5_rff_quality": op5_rff_quality,
    "op6_simhash_trie": op6_simhash_trie,
    "op7_prefix_counts": op7_prefix_counts,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_gru_scoring": op9_gru_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_gnat_negatives": op11_gnat_negatives,
    "op12_voronoi_join": op12_voronoi_join,
    "op13_importance_resampling": op13_importance_resampling,
}

#: The other queries cannot be stated in SQL; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_line_winnow": OP3_SQL,
    "op4_vantage_trees": OP4_SQL,
    "op11_gnat_negatives": OP11_SQL,
    "op12_voronoi_join": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
