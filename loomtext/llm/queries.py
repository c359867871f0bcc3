"""The registered queries of this subpackage, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, licenses, near_dup, packing, quality, scratch, suffix_dedup, token_store, toxicity, url_filter

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.Store.write(table(spark, sf_dir, "documents"), scratch.new_path(spark, "store"), public_tokenizers.path(TOKENIZER))
    return store.summary().select("doc_id", "start", "n_tokens", "ids_crc32", F.hex("root").alias("root"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.default_rules(spark))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_at", "longest_item", "longest_item_at")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_store, op2_quality, op3_licenses, op4_suffix_dedup, op5_url_filter, op6_decontaminate, op7_packing, op8_fingerprints, op9_toxicity, op10_near_dup)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op6_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS t, coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS ws FROM benchmark),
bo AS (SELECT item, t, k, s AS o, list_slice(ws, s, s + k - 1) AS win
       FROM (SELECT item, t, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM (SELECT *, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0))),
bw AS (SELECT DISTINCT item, k, win FROM bo),
dw AS (SELECT rid, k, s, list_slice(ws, s, s + k - 1) AS win
       FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
hits AS (SELECT dw.rid, dw.s, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid),
islands AS (SELECT rid, item, count(*) + min(k) - 1 AS n FROM (SELECT dw.rid, bo.item, dw.k, dw.s, dw.s - bo.o AS d, dw.s - row_number() OVER (PARTITION BY dw.rid, bo.item, bo.t, dw.s - bo.o ORDER BY dw.s) AS g, bo.t
            FROM dw JOIN bo ON dw.k = bo.k AND dw.win = bo.win) GROUP BY rid, item, t, d, g),
longest AS (SELECT rid, max(n) AS longest FROM islands GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid) LEFT JOIN longest USING (rid)
""",
}
