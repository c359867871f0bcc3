"""Summaries of a tree: languages, directories, layout, entry points, central files, file index, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What counts as a type, as a function and as an entry point's name; endings that an import may leave out; rows of a layout.
TYPE_KINDS = ("struct", "union", "enum", "trait", "type", "typedef", "class", "interface", "protocol")
FUNCTION_KINDS = ("fn", "function", "def", "func", "fun")
ENTRY_STEMS = ("main", "cli", "server", "app", "index")
ENTRY_NAMES = ("main.rs", "main.go", "main.c", "main.cc", "main.cpp", "__main__.py", "manage.py")
ENDINGS = ("", ".rs", ".ts", ".tsx", ".js", ".py", "/mod.rs", "/index.ts", "/index.tsx", "/index.js")
LAYOUT_ROWS = 14


def language_mix(files: DataFrame, most: int = 6) -> DataFrame:
    """language, files, loc, percent of the largest languages."""
    by = files.groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    total = files.agg(F.sum("loc").alias("total"))  # one row
    out = by.crossJoin(F.broadcast(total)).select("language", "files", "loc", F.floor(F.col("loc") * 100 / F.greatest("total", F.lit(1))).cast("long").alias("percent"))
    return out.orderBy(F.desc("loc"), "language").limit(most)


def rollup(files: DataFrame) -> DataFrame:
    """directory, files, loc of every directory with all that is below it; the root is empty."""
    parts = F.split(T.parent(F.col("path")), "/")
    above = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    own = files.groupBy(T.parent(F.col("path")).alias("path")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).withColumn("path", F.concat("path", F.lit("/x")))
    return own.select(F.explode(above).alias("directory"), "files", "loc").groupBy("directory").agg(F.sum("files").alias("files"), F.sum("loc").alias("loc"))


def directories(files: DataFrame, cap: int = 3) -> DataFrame:
    """directory, files, loc, line: per directory its `cap` largest files and how many more. Names are without their ending if all files of a directory have the same."""
    rows = files.select("path", "loc", T.parent(F.col("path")).alias("directory"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.regexp_extract("path", r"\.([^.]*)$", 1).alias("ext"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("loc"), "path")))
    top = ranked.groupBy("directory").agg(
        F.count("*").alias("files"), F.sum("loc").alias("loc"), F.min("ext").alias("low"), F.max("ext").alias("high"), F.array_sort(F.collect_list(F.when(F.col("k") <= cap, F.struct("k", "name")))).alias("top")
    )
    shared = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("")
    bare = lambda n: F.when(shared != "", F.substring(n, F.lit(1), F.length(n) - F.length(shared) - 1)).otherwise(n)
    label = F.when(F.col("directory") == "", ".").otherwise(F.concat("directory", F.lit("/")))
    kind = F.when(shared != "", F.concat(F.lit(", ."), shared)).otherwise("")
    more = F.when(F.col("files") > cap, F.concat(F.lit(" +"), (F.col("files") - cap).cast("string"))).otherwise("")
    line = F.concat(label, F.lit(" ("), F.col("files").cast("string"), kind, F.lit("): "), F.array_join(F.transform("top", lambda x: bare(x["name"])), " "), more)
    return top.select("directory", "files", "loc", line.alias("line"))


def owners(files: DataFrame, packages: DataFrame) -> DataFrame:
    """doc_id, owner: the deepest package directory above each file, else its top directory; the root (empty) never owns."""
    parts = F.split(T.parent(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    found = files.select("doc_id", F.explode(above).alias("directory")).join(packages.where("directory <> ''"), "directory").groupBy("doc_id").agg(F.max_by("directory", F.length("directory")).alias("owner"))
    return files.join(found, "doc_id", "left").select("doc_id", F.coalesce("owner", F.regexp_extract("path", "^([^/]*)/", 1)).alias("owner"))


def layout(files: DataFrame, packages: DataFrame, most_files: int = 3000, rows: int = LAYOUT_ROWS) -> DataFrame:
    """directory, files, loc: packages, if there are two or more and not too many files; else top directories, the dominant ones split into their largest children.

    Splitting works on one row for each directory (its files and lines), which is
    all that the driver sees.
    """
    if packages.where("directory <> ''").limit(2).count() == 2 and files.count() <= most_files:
        return files.select("doc_id", "loc").join(owners(files, packages), "doc_id").groupBy(F.col("owner").alias("directory")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    own = files.groupBy(T.parent(F.col("path")).alias("directory")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    groups = split_directories([(r["directory"], r["files"], r["loc"]) for r in own.collect()], rows)  # a row for each directory
    return files.sparkSession.createDataFrame(groups, "directory string, files long, loc long")


def split_directories(sizes: list[tuple[str, int, int]], rows: int = LAYOUT_ROWS) -> list[tuple[str, int, int]]:
    """The rows of a layout from (directory, files, lines) of each directory's own files."""
    shown = {d.split("/")[0] for d, _, _ in sizes}
    total, limit = max(1, sum(x for _, _, x in sizes)), max(rows, len(shown) + 8)

    def owner(directory: str) -> str:
        while directory and directory not in shown:
            directory = directory.rpartition("/")[0]
        return directory

    def grouped() -> dict[str, list[tuple[str, int, int]]]:
        out: dict[str, list[tuple[str, int, int]]] = {}
        for row in sizes:
            out.setdefault(owner(row[0]), []).append(row)
        return out

    while len(shown) < limit:
        groups, children = grouped(), {}
        for name, mine in sorted(((n, m) for n, m in groups.items() if n), key=lambda g: (-sum(x[2] for x in g[1]), g[0])):
            if 4 * sum(x[2] for x in mine) < total:
                break
            for d, _, loc in mine:
                if d != name:
                    child = f"{name}/{d[len(name) + 1 :].split('/')[0]}"
                    children[child] = children.get(child, 0) + loc
            if children:
                break
        if not children:
            break
        shown |= set(sorted(children, key=lambda c: (-children[c], c))[: max(1, limit - len(shown))])
    done = [(name, sum(x[1] for x in mine), sum(x[2] for x in mine)) for name, mine in grouped().items()]
    return sorted(done, key=lambda g: (-g[2], g[0]))


def entry_points(files: DataFrame, packages: DataFrame) -> DataFrame:
    """doc_id, path, loc, depth of files that a program starts from."""
    name, home = F.regexp_extract("path", "[^/]*$", 0), T.parent(F.col("path"))
    above = F.when((home == "src") | home.endswith("/src"), T.parent(home))
    rows = files.select("doc_id", "path", "loc", name.alias("name"), home.alias("home"), above.alias("above"))
    known = packages.select("directory").distinct()
    rows = rows.join(known.select(F.col("directory").alias("home"), F.lit(True).alias("at_home")), "home", "left").join(known.select(F.col("directory").alias("above"), F.lit(True).alias("at_above")), "above", "left")
    at_package = F.coalesce("at_home", F.lit(False)) | F.coalesce("at_above", F.lit(False))
    yes = F.col("name").isin(*ENTRY_NAMES) | F.col("home").endswith("src/bin") | (at_package & F.regexp_extract("name", "^[^.]*", 0).isin(*ENTRY_STEMS))
    rows = rows.where(~T.language(F.col("path")).isin("CSS", "HTML", "other") & ~F.col("name").endswith(".d.ts") & yes)
    return rows.select("doc_id", "path", "loc", (F.size(F.split("path", "/")) - 1).alias("depth"))


def substantive(definitions: Column) -> Column:
    """2 with eight functions or more, 1 with any, else 0."""
    n = F.size(F.filter(definitions, lambda d: F.substring_index(d, " ", 1).isin(*FUNCTION_KINDS)))
    return F.when(n == 0, 0).when(n < 8, 1).otherwise(2)


def resolve_imports(files: DataFrame) -> DataFrame:
    """doc_id, import, target: the file that an import means, by equi-joins of its candidates in order; without one the import itself."""
    raw = files.select("doc_id", "path", F.explode("imports").alias("import")).withColumn("plain", F.translate("import", "\\", "/"))
    home = T.parent(F.col("path"))
    base = F.when(F.col("plain").startswith("."), T.normal_path(F.concat(home, F.lit("/"), "plain"))).when(
        F.col("plain").startswith("crate::"), F.concat(F.lit("src/"), F.replace(F.substring("plain", 8, 1 << 20), F.lit("::"), F.lit("/")))
    ).otherwise(F.replace(F.col("plain"), F.lit("::"), F.lit("/")))
    tries = F.concat(F.array("plain"), F.array(*(F.concat("base", F.lit(e)) for e in ENDINGS)))
    every = raw.withColumn("base", base).select("doc_id", "import", F.posexplode(tries).alias("k", "target"))
    found = every.join(files.select(F.col("path").alias("target")).distinct(), "target").groupBy("doc_id", "import").agg(F.min_by("target", "k").alias("target"))
    return raw.join(found, ["doc_id", "import"], "left").select("doc_id", "import", F.coalesce("target", "plain").alias("target"))


def central(files: DataFrame, refs: DataFrame, most: int = 8) -> DataFrame:
    """owner, path, users: files that two others or more import, or name a type of that only they define, in a related language. refs: doc_id, symbol, owner."""
    imported = resolve_imports(files).join(files.select(F.col("doc_id").alias("owner"), F.col("path").alias("target")), "target").where("owner <> doc_id").select("owner", "doc_id")
    family = files.select("doc_id", T.language_family(F.col("path")).alias("family"))
    kind = F.substring_index("d", " ", 1)
    types = files.select(F.col("doc_id").alias("owner"), F.explode("definitions").alias("d")).where(kind.isin(*TYPE_KINDS)).select("owner", F.expr("substring(d, instr(d, ' ') + 1)").alias("symbol")).distinct()
    named = refs.join(types, ["owner", "symbol"]).join(family, "doc_id").join(family.withColumnsRenamed({"doc_id": "owner", "family": "of"}), "owner").where("family = of and owner <> doc_id").select("owner", "doc_id")
    users = imported.union(named).distinct().groupBy("owner").agg(F.count("*").alias("users")).where("users >= 2")
    rows = users.join(files.select(F.col("doc_id").alias("owner"), "path"), "owner").where(~T.test_like(F.col("path")))
    return rows.select("owner", "path", "users").orderBy(F.desc("users"), "path").limit(most)


def compact_line(files: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, line: path, lines and the first names of definitions."""
    names = F.slice(F.filter(F.transform("definitions", lambda d: F.when(d.contains(" "), F.regexp_extract(d, "^[^ ]* (.*)$", 1)).otherwise("")), lambda n: n != ""), 1, most)
    head = F.concat("path", F.lit(" | "), F.col("loc").cast("string"), F.lit(" LOC"))
    return files.select("doc_id", F.when(F.size(names) == 0, head).otherwise(F.concat(head, F.lit(" | "), F.array_join(names, " "))).alias("line"))


def full_section(files: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """doc_id, section: a head line, then definitions, imports and, with refs (doc_id, symbol), references, each cut."""
    rows = files
    if refs is not None:
        rows = rows.join(refs.groupBy("doc_id").agg(F.array_sort(F.collect_set("symbol")).alias("refs")), "doc_id", "left")
    limits = {"definitions": ("defs", 24), "imports": ("imports", 24)} if refs is None else {"definitions": ("defs", 18), "imports": ("imports", 12), "refs": ("refs", 16)}
    out = [F.concat("path", F.lit(" | "), F.col("loc").cast("string"), F.lit(" LOC\n"))]
    for column, (name, most) in limits.items():
        out.append(F.when(F.coalesce(F.size(column), F.lit(0)) > 0, F.concat(F.lit(f"  {name}: "), F.array_join(F.slice(column, 1, most), "; "), F.lit("\n"))).otherwise(""))
    return rows.select("doc_id", F.concat(*out).alias("section"))


def render(files: DataFrame, symbols: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, line: path, lines and the first symbols of each file."""
    k = Window.partitionBy("doc_id").orderBy("symbol")
    some = symbols.withColumn("k", F.row_number().over(k)).where(F.col("k") <= most).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("symbol")), " ").alias("names"))
    rows = files.select("doc_id", "path", "loc").join(some, "doc_id", "left")
    head = F.concat("path", F.lit(" | "), F.col("loc").cast("string"), F.lit(" LOC"))
    return rows.select("doc_id", F.when(F.col("names").isNull(), head).otherwise(F.concat(head, F.lit(" | "), "names")).alias("line"))
