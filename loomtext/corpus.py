"""How tables stand in for a tree of files: paths, lines, symbols, definitions, questions, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T

FOLDERS = ("src/", "src/bin/", "tests/", "lib/", "docs/examples/", "")
STEMS = ("main", "cli", "util", "index", "server", "test_io", "app.test", "mod", "__main__", "core")
EXTENSIONS = ("rs", "py", "ts", "go", "c", "js", "java")
KINDS = ("fn", "struct", "def", "class", "const", "trait", "func")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text, language, loc, changed, entrypoint, tokens."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        "doc_id",
        F.concat("source", F.lit("/p"), (F.col("doc_id") % 7).cast("string"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        text.alias("text"), F.col("lang").alias("language"), T.lines(text).alias("loc"),
        (F.col("doc_id") % 17 == 0).alias("changed"), (F.col("doc_id") % 97 == 0).alias("entrypoint"), T.token_estimate(text).alias("tokens"),
    )


def first_names(text: Column) -> Column:
    """The first identifier of each line, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_extract(x, "[A-Za-z0-9_]+", 0)), lambda s: s != ""))


def with_symbols(files: DataFrame) -> DataFrame:
    """files with their symbols as an array."""
    return files.withColumn("symbols", first_names(F.col("text")))


def symbols(files: DataFrame) -> DataFrame:
    """Distinct (doc_id, symbol): the first identifier of each line."""
    return files.select("doc_id", F.explode(first_names(F.col("text"))).alias("symbol"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the first eight words of each benchmark passage."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", "[ \n]+"), 1, 8), " ").alias("query"), F.col("text").alias("passage"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, mentioned_paths, mentioned_symbols, open_paths: a question names the path of the document with its number, each of its identifiers as a symbol, and has the next document open."""
    q = queries(spark, sf_dir)
    paths = documents(spark, sf_dir).select("doc_id", "path")
    at = lambda step, name: q.select("query_id", (F.col("query_id") + step).alias("doc_id")).join(paths, "doc_id").groupBy("query_id").agg(F.collect_set("path").alias(name))
    none = F.array().cast("array<string>")
    rows = q.join(at(0, "mentioned_paths"), "query_id", "left").join(at(1, "open_paths"), "query_id", "left")
    return rows.select("query_id", "query", F.coalesce("mentioned_paths", none).alias("mentioned_paths"), T.identifier_runs(F.col("query")).alias("mentioned_symbols"), F.coalesce("open_paths", none).alias("open_paths"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree of code: doc_id, path, loc, entrypoint, definitions (kind and name), symbols, imports. Directories whose name begins with pkg0, pkg1 or pkg2 hold packages."""
    i = F.col("doc_id")
    group = F.concat(F.lit("pkg"), (i % 5).cast("string"), F.lit("/g"), F.floor(i / 300).cast("string"), F.lit("/"))
    path = F.concat(group, _pick(FOLDERS, F.floor(i / 5) % 6), _pick(STEMS, F.floor(i / 30) % 10), F.lit("."), _pick(EXTENSIONS, i % 7))
    files = documents(spark, sf_dir).withColumns({"path": path, "names": first_names(F.col("text"))})
    imports = F.array(F.lit("./util"), F.concat(F.lit("../src/"), _pick(STEMS, i % 10)), F.lit("no::such"))
    return files.select(
        "doc_id", "path", "text", "loc", "tokens", F.regexp_extract("path", "[^/]*$", 0).isin("main.rs", "lib.rs", "index.ts").alias("entrypoint"),
        F.array_sort(F.transform("names", lambda s: F.concat(_pick(KINDS, F.length(s) % 7), F.lit(" "), s))).alias("definitions"), F.array_sort("names").alias("symbols"), F.array_sort(F.array_distinct(imports)).alias("imports"),
    )


def packages(files: DataFrame) -> DataFrame:
    """directory: the roots of packages in tree()."""
    return files.select(F.regexp_extract("path", "^(pkg[012]/g[0-9]+)/", 1).alias("directory")).where("directory <> ''").distinct()


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, repo, query, gold (array), order: commits as evaluation cases. A conversation's turn is a subject; gold are the paths of the documents with its number and the double of it."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.col("conv_id")
    gold = F.array_distinct(F.array(*(F.concat(F.lit("src/area"), (x % 11).cast("string"), F.lit("/file"), (x % 23).cast("string"), F.lit(".rs")) for x in (n, 2 * n))))
    label = F.concat(n.cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return c.select(label.alias("id"), F.concat(F.lit("repo"), (n % 4).cast("string")).alias("repo"), F.col("text").alias("query"), F.array_sort(gold).alias("gold"), F.sha2(label, 256).alias("digest"))
