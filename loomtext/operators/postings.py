"""Postings, document frequencies and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def term_counts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, tf."""
    return rows.select(key, F.explode(T.terms(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def postings(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """doc_id, field (body, path, symbol), term, tf."""
    parts = [("body", files, F.col("text")), ("path", files, F.col("path")), ("symbol", symbols, F.col("symbol"))]
    out = None
    for name, rows, text in parts:
        one = term_counts(rows, "doc_id", text).withColumn("field", F.lit(name))
        out = one if out is None else out.union(one)
    return out.select("doc_id", "field", "term", "tf")


def lengths(posts: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, len: body terms and three times path terms, 0 without any."""
    weight = F.when(F.col("field") == "body", F.col("tf")).when(F.col("field") == "path", 3 * F.col("tf")).otherwise(0)
    return files.select("doc_id").join(posts.groupBy("doc_id").agg(F.sum(weight).alias("len")), "doc_id", "left").select("doc_id", F.coalesce("len", F.lit(0)).alias("len"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.where("field <> 'symbol'").groupBy("term").agg(F.countDistinct("doc_id").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, alt: a query's distinct terms and their other number."""
    t = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))
    return t.select("query_id", "term", T.plural(F.col("term")).alias("alt"))
