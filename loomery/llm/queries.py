"""Registered queries of this subpackage, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import conversation_trie, exact_dedup, lm_score, media, mixing, near_dup, packing, pii, token_counts, token_files, toxicity, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class, and its number of links of similarity 0.8 or more."""
    return near_dup.near_classes(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after edits that touch each of them."""
    return token_counts.count_with_edits(_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.listed_pages(pages)).select("page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of personal data in each document, and all spans."""
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-quantisation codes of all vectors, with six rounds of Lloyd."""
    return vector_codes.compress_vectors(_table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations."""
    return conversation_trie.rebuilt_trie(_table(spark, sf_dir, "conversations")).drop("digest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dup, op2_exact_dedup, op3_token_counts, op4_lm_score, op5_mixing, op6_url_filter, op7_packing, op8_token_files, op9_toxicity, op10_media, op11_pii, op12_vector_codes, op13_conversation_trie)
}

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS flat
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY flat) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(flat) AS text_sha256
FROM d WINDOW w AS (PARTITION BY flat ORDER BY n_points DESC, doc_id)
"""

OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
by_source AS (
  SELECT source, sum(size)::DOUBLE AS s, (ARRAY[3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2 * s AS cap, 2 * s / w AS own,
         (1.5 * sum(s) OVER () - coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM by_source),
free AS (SELECT level FROM levels WHERE own > level ORDER BY own, source NULLS LAST LIMIT 1),
targets AS (SELECT source, s, CASE WHEN own <= level THEN cap ELSE w * (SELECT level FROM free) END AS target FROM levels),
drawn AS (
  SELECT doc_id, size, s, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS chance
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, s::BIGINT AS source_size, target,
       (size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""

OP6_SQL = r"""
WITH named AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
canon AS (
  SELECT *, regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(\.html)?/*$', '') AS canonical FROM named),
listed AS (
  SELECT DISTINCT canonical FROM canon
  WHERE canonical <> '' AND len(list_intersect(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])) > 0),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fitting AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC) AS n
  FROM canon JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN (SELECT page_id, rule, v FROM fitting WHERE n = 1) USING (page_id)
"""



def _lloyd_round(r: int) -> str:
    """Assignment with codebook r and the codebook after it."""
    return f"""
a{r} AS MATERIALIZED (
  SELECT r, p, x, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d
  FROM (SELECT r, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut JOIN b{r} USING (p)) GROUP BY r, p, x),
m{r} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c
  FROM (SELECT p, e, k, sum(x[k])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, width + 1)) AS k FROM size) GROUP BY p, e, k) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e)),"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT len(v) // 8 AS width FROM kept WHERE r = 1),
cut AS MATERIALIZED (SELECT r, p, v[p * width + 1 : p * width + width] AS x FROM kept, size, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= 16),{"".join(map(_lloyd_round, range(7)))}
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b6) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""

#: Unsigned crc32 of a decimal number, bit by bit: DuckDB has no function for it.
_CRC32 = """xor(list_reduce(list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
  lambda a, b: list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295), 4294967295)"""
OP13_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM keyed),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {_CRC32.format("conv_id")} % 4 AS h FROM placed),
rebuilt AS (
  SELECT c.conv_id, p.pos, p.k, p.words FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
  UNION ALL SELECT c.conv_id, p.pos, p.k, p.words FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h),
prefixed AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(k, '') OVER w AS node, words FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
ended AS (SELECT conv_id, arg_max(node, depth) AS node FROM prefixed GROUP BY 1),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, CASE WHEN depth > 0 THEN left(node, 64 * (depth - 1)::INT) END AS parent
  FROM prefixed GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
valued AS (SELECT nodes.*, coalesce(n, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes LEFT JOIN children USING (node)),
sums AS (
  SELECT left(node, 64 * d::INT) AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM valued) GROUP BY 1),
listed AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM ended GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM valued v JOIN sums USING (node) LEFT JOIN listed USING (node) LEFT JOIN nodes p ON v.parent = p.node
"""

ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op5_mixing": OP5_SQL, "op6_url_filter": OP6_SQL, "op12_vector_codes": OP12_SQL, "op13_conversation_trie": OP13_SQL}
