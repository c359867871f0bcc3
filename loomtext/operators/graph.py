"""Symbols: unique definers, references, unique callers, the index of path endings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import stored


#: References that a file has at most.
MOST_REFERENCES = 64


def definers(symbols: DataFrame) -> DataFrame:
    """symbol, owner: distinctive symbols with one definer."""
    one = symbols.where(T.distinctive(F.col("symbol"))).groupBy("symbol").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"))
    return one.where("n = 1").select("symbol", "owner")


def references(files: DataFrame, definers: DataFrame, most: int = MOST_REFERENCES, named: DataFrame | None = None) -> DataFrame:
    """doc_id, symbol, owner: identifiers of a file that one other file defines; the first `most`, those that are named (symbol) before others, each by name."""
    used = files.select("doc_id", F.explode(T.identifier_runs(F.col("text"))).alias("symbol"))
    found = used.join(definers, "symbol").where("owner <> doc_id")
    order = [F.asc("symbol")]
    if named is not None:
        found = found.join(named.select("symbol").distinct().withColumn("first", F.lit(0)), "symbol", "left").withColumn("first", F.coalesce("first", F.lit(1)))
        order = [F.asc("first"), *order]
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return found.withColumn("k", k).where(F.col("k") <= most).select("doc_id", "symbol", "owner")


def unique_callers(refs: DataFrame) -> DataFrame:
    """symbol, caller: symbols that exactly one file refers to."""
    return refs.groupBy("symbol").agg(F.count("*").alias("n"), F.min("doc_id").alias("caller")).where("n = 1").select("symbol", "caller")


def callers_of(files: DataFrame, symbols: DataFrame, named: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """symbol, caller: unique_callers of all references, for some symbols only (named: symbol, a few).

    Only files that use one of these symbols are looked at as a whole, which they
    must be: a file has so many references at most. A file with no more runs than
    that keeps all of them; a symbol that two such files use has no unique caller,
    and nothing is looked at for it. used: doc_id, symbol, sure (whether the file is
    such), where named symbols are runs of the text, if that is known.
    """
    some = F.broadcast(named.select("symbol").distinct())
    owned = stored(definers(symbols.join(some, "symbol")), "owned")
    if used is None:
        runs = files.select("doc_id", T.identifier_runs(F.col("text")).alias("runs"))
        used = runs.select("doc_id", (F.size("runs") <= MOST_REFERENCES).alias("sure"), F.explode("runs").alias("symbol"))
    used = stored(used.join(F.broadcast(owned), "symbol").where("owner <> doc_id").select("doc_id", "symbol", "sure"), "used")
    several = used.where("sure").groupBy("symbol").agg(F.count("*").alias("n")).where("n > 1").select("symbol")
    open_ = stored(used.join(F.broadcast(several), "symbol", "left_anti"), "open")
    if open_.isEmpty():
        return files.sparkSession.createDataFrame([], f"symbol string, caller {files.schema['doc_id'].dataType.simpleString()}")
    users, left = open_.select("doc_id").distinct(), F.broadcast(open_.select("symbol").distinct())
    return unique_callers(references(files.join(users, "doc_id", "left_semi"), definers(symbols)).join(left, "symbol", "left_semi"))


def suffix_index(files: DataFrame) -> DataFrame:
    """suffix, n, doc_id: path endings at component borders, with their only file (null if several)."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    one = files.select("doc_id", F.explode(ends).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    return one.select("suffix", "n", F.when(F.col("n") == 1, F.col("doc_id")).alias("doc_id"))
