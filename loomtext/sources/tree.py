"""A tree of source files as a table, and a feature table that spares unchanged files their parsing.

Listing, reading and filtering are Spark's: ``binaryFile`` takes any file system
Spark knows, pushes the size limit into the scan and reads contents only if they
are asked for.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LARGEST = 4 << 20
# What counts as source, and which directories never do.
EXTENSIONS = ("rs", "py", "java", "kt", "kts", "swift", "cs", "rb", "php", "go", "ts", "tsx", "js", "jsx", "mjs", "cjs", "svelte", "vue", "c", "h", "cc", "cpp", "hpp", "sh", "html", "css", "scss")
PRUNED = ("node_modules", "bower_components", "__pycache__")
MARKERS = ("CACHEDIR.TAG", "CMakeCache.txt", "pyvenv.cfg")
IGNORE_FILES = (".gitignore", ".ignore", ".loomignore")
#: Rules that git keeps for a whole tree, and that hold for its root.
EXCLUDES = ".git/info/exclude"


def _listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path (below root), size, mtime, content of all files whose names match."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(top).toString().rstrip("/")
    return raw.select(F.expr(f"substring(path, {len(top) + 2})").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def _named(spark: SparkSession, root: str, names: tuple[str, ...]) -> list[str]:
    """Paths below root of the files with one of these names. Spark's readers leave out hidden and empty ones, so the file system lists them."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    cut, out, each = len(fs.makeQualified(top).toString().rstrip("/")) + 1, [], fs.listFiles(top, True)
    while each.hasNext():
        path = each.next().getPath()
        if path.getName() in names:
            out.append(path.toString()[cut:])
    return out


def _text(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, without the root."""
    parts = F.split(path, "/")
    ends = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """An ignore pattern as a regex over paths below its own folder, and whether it un-ignores; None for blanks and comments."""
    p = pattern.rstrip()
    if not p or p.startswith("#"):
        return None
    back = p.startswith("!")
    p = p[1:] if back else p
    only_dirs, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    out = ""
    for token in re.findall(r"/\*\*/|^\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\]|\\.|.", p):
        match token:
            case "/**/":
                out += "/(?:.*/)?"
            case "**/":
                out += "(?:.*/)?"
            case "/**":
                out += "/.*"
            case "**":
                out += ".*"
            case "*":
                out += "[^/]*"
            case "?":
                out += "[^/]"
            case _:
                out += token.replace("[!", "[^") if token[0] == "[" else re.escape(token[-1])
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_dirs else "(?:/.*)?$"), back


def _ignored(rules: list[tuple[str, str]]) -> Column:
    """Whether the last rule (folder, pattern) that matches a path ignores it."""
    out = F.lit(False)
    for folder, pattern in rules:
        if (made := ignore_regex(pattern)) is None:
            continue
        regex, back = made
        inside = F.col("path").startswith(folder + "/") if folder else F.lit(True)
        below = F.expr(f"substring(path, {len(folder) + 2})") if folder else F.col("path")
        out = F.when(inside & below.rlike(regex), F.lit(not back)).otherwise(out)
    return out


def files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, largest: int = LARGEST) -> DataFrame:
    """path, size, mtime, text of the source files below root, hidden, ignored, pruned, oversized and non-UTF-8 ones left out."""
    rows = _listed(spark, root, "*").where(F.col("size") <= largest)
    rows = rows.where(F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)).isin(*extensions))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\.")).where(~F.col("path").rlike(f"(^|/)({'|'.join(PRUNED)})/"))
    # Ignore files are few and small: each is read once, outer folders first.
    named = [p for p in _named(spark, root, (*IGNORE_FILES, *MARKERS, "exclude")) if p.rpartition("/")[2] != "exclude" or p == EXCLUDES]
    found = sorted((p for p in named if p == EXCLUDES or not p.startswith(".git/")), key=lambda p: (p != EXCLUDES, p.count("/"), p))
    rules = [("" if p == EXCLUDES else p.rpartition("/")[0], line) for p in found if p == EXCLUDES or p.rpartition("/")[2] in IGNORE_FILES for line in _text(spark, f"{root}/{p}").splitlines()]
    rows = rows.where(~_ignored(rules))
    marked = [(d,) for p in found if p.rpartition("/")[2] in MARKERS and (d := p.rpartition("/")[0])]
    marked = spark.createDataFrame(marked, "directory string").distinct()
    inside = rows.select("path", F.explode(ancestors(F.col("path"))).alias("directory")).join(marked, "directory").select("path").distinct()
    rows = rows.join(inside, "path", "left_anti").select("path", "size", "mtime", F.col("content").cast("string").alias("text"))
    return rows.where(F.is_valid_utf8("text"))


class Features:
    """A table of parsed files by path, size and time, in generations: a new one is complete before it is read.

    A generation of another version, or one that can't be read, counts as empty.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str, keep: int = 2):
        self.spark, self.folder, self.version, self.keep = spark, folder.rstrip("/"), version, keep
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _generations(self) -> list[str]:
        top = self.path(f"{self.folder}/{self.version}")
        if not self.fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(top)]
        return sorted(n for n in names if self.fs.exists(self.path(f"{self.folder}/{self.version}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        for name in reversed(self._generations()):
            try:
                return self.spark.read.parquet(f"{self.folder}/{self.version}/{name}")
            except AnalysisException:
                continue
        return None

    def split(self, listed: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """Rows of unchanged files, and the files that are new or changed."""
        known = self.read()
        if known is None:
            return None, listed
        key = ["path", "size", "mtime"]
        return known.join(listed.select(*key), key, "left_semi"), listed.join(known.select(*key), key, "left_anti")

    def publish(self, rows: DataFrame) -> DataFrame:
        """Writes a new generation with exactly these rows, drops old ones and reads it back."""
        have = self._generations()
        number = int(have[-1].split("-")[0]) + 1 if have else 0
        name = f"{number:08d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{self.version}/{name}")
        for old in have[: max(0, len(have) + 1 - self.keep)]:
            self.fs.delete(self.path(f"{self.folder}/{self.version}/{old}"), True)
        return self.spark.read.parquet(f"{self.folder}/{self.version}/{name}")

    def refresh(self, listed: DataFrame, parse) -> DataFrame:
        """The features of all listed files; parse (a function of a DataFrame) only sees those that are new or changed."""
        old, new = self.split(listed)
        made = parse(new)
        return self.publish(made if old is None else old.select(*made.columns).union(made))
