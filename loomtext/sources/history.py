"""What git knows: changed paths, and commits as evaluation cases."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tree import EXTENSIONS

# Subjects that are no tasks.
SKIPPED = r"(?i)^(merge|revert|bump|release|version|wip|fmt|format|lint|typo|initial commit|deps\b)"


def git(root: str, *args: str) -> str:
    """Output of a git command; empty if the folder is no repository."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def changed(files: DataFrame, root: str) -> DataFrame:
    """path of files that differ from the last commit, or that git doesn't track. files: path."""
    spark = files.sparkSession
    named = lambda *args: spark.createDataFrame([(p,) for p in git(root, *args).split("\0") if p], "path string")
    if not git(root, "rev-parse", "--git-dir"):
        return files.select("path").limit(0)
    return named("diff", "--name-only", "--relative", "-z", "HEAD").union(files.select("path").join(named("ls-files", "-z"), "path", "left_anti")).distinct()


def commits(spark: SparkSession, root: str, revisions: tuple[str, ...] = ()) -> DataFrame:
    """commit, parent, subject, changes (array of status, path), without merges and first commits."""
    log = git(root, "log", "--no-merges", "--no-renames", "--format=%x00%H %P%x01%s", "--name-status", *revisions)
    blocks = spark.createDataFrame([(b,) for b in log.split("\0")[1:]], "block string")
    head, rows = F.substring_index("block", "\n", 1), F.split(F.regexp_replace("block", r"^[^\n]*\n?", ""), "\n")
    parts = F.split(F.substring_index(head, "\x01", 1), " ")
    change = lambda r: F.struct(F.substring_index(r, "\t", 1).alias("status"), F.regexp_extract(r, r"^[^\t]*\t(.*)$", 1).alias("path"))
    return blocks.where(F.size(parts) == 2).where(parts[1] != "").select(
        parts[0].alias("commit"), parts[1].alias("parent"), T.normal_space(F.regexp_extract(head, "\x01(.*)$", 1)).alias("subject"), F.transform(F.filter(rows, lambda r: r.contains("\t")), change).alias("changes")
    )


def test_path(path: Column) -> Column:
    """Whether a commit's path is of a test."""
    low = F.lower(F.concat(F.lit("/"), path))
    return low.rlike(r"/tests?/|__tests__|/test_[^/]*$|\.(test|spec)\.[^/]*$|_test\.go$")


def cases(found: DataFrame, repo: str) -> DataFrame:
    """commits() as cases: id, repo, commit, parent, query, gold, kind, tests_only, added_files, digest, of commits that are a task with one to five changed source files."""
    source = lambda p: F.lower(T.extension(p)).isin(*EXTENSIONS)
    gold = F.array_sort(F.filter("changes", lambda c: (c["status"] == "M") & source(c["path"]))["path"])
    rows = found.withColumns({"query": T.clean_query(F.col("subject")), "gold": gold})
    rows = rows.where((F.size(F.split(T.normal_space(F.col("query")), r"(?U)\s+")) >= 4) & ~F.col("query").rlike(SKIPPED) & F.size("changes").between(1, 15) & F.size("gold").between(1, 5))
    lexical = F.arrays_overlap(T.task_words(F.col("query")), T.task_words(F.array_join("gold", " ")))
    return rows.select(
        F.concat(F.lit(f"{repo}-"), F.substring("commit", 1, 10)).alias("id"), F.lit(repo).alias("repo"), "commit", "parent", "query", "gold", F.when(lexical, "lexical").otherwise("conceptual").alias("kind"),
        F.forall("gold", test_path).alias("tests_only"), F.size(F.filter("changes", lambda c: c["status"] == "A")).alias("added_files"), F.sha2(F.concat(F.lit(f"{repo}:"), "commit"), 256).alias("digest"),
    )


# Fixed value: what may stand before a task's own words.
PREFIX = r"^(?:[^\s:]+(?: [^\s:]+)?:\s+|\([^)]*\)\s+|\[[^\]]*\]\s*)"


def bare_cases(found: DataFrame) -> DataFrame:
    """cases() whose queries have lost all prefixes: with_prefix is the query as it was; those left with under three words go."""
    rows = found.withColumnsRenamed({"query": "with_prefix"}).withColumn("query", F.regexp_replace("with_prefix", rf"^(?:{PREFIX[1:]})+", ""))
    rows = rows.where(F.size(F.split(T.normal_space(F.col("query")), r"(?U)\s+")) >= 3)
    lexical = F.arrays_overlap(T.task_words(F.col("query")), T.task_words(F.array_join("gold", " ")))
    return rows.withColumn("kind", F.when(lexical, "lexical").otherwise("conceptual"))
