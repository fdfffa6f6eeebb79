"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmlmain, jaccard, langid, media, packing, repair, sharding, tokencount, urltrie
from .util import small_batches, table

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return media.ogg_read(media.ogg_store(table(spark, sf_dir, "documents")), carry=("n_bytes",))


def op2_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op3_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(langid.remainder() == 2, F.lit(False)))
    model = langid.train(docs.where(langid.remainder() != 2))
    return langid.predict(docs, model, carry=("held_out",))


def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return htmlmain.main_text(table(spark, sf_dir, "pages"))


def op8_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrie.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op10_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repair.read_shards(repair.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

OP7_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
    THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
hits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1
"""


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reached(node, least) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT b, least FROM reached JOIN links ON a = node WHERE least < b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(least) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reached r ON r.node = d.doc_id GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard": OP5_SQL, "op7_url_trie": OP7_SQL}
