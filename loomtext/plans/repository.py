"""Maps of a tree of source files: the overview, the map for a task, the plain list."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as T
from ..operators import graph as G
from ..operators import overview as O
from ..operators import ranking as R
from ..operators.tables import shared_folder, stored
from ..sources import documents as D
from ..sources import history, readers, tree

VERSION = "2"
#: Files above which a task looks at the best by path only, and an overview at imports only.
MOST_FILES = 3000
NOTHING_FITS = "No files fit the repo-map token budget."
NO_FILES = "no source files found"


@dataclass
class Result:
    ok: bool
    output: str
    truncated: bool = False
    exit_code: int | None = None


@dataclass
class Task:
    query: str = ""
    mentioned_paths: list[str] = field(default_factory=list)
    mentioned_symbols: list[str] = field(default_factory=list)
    open_paths: list[str] = field(default_factory=list)
    budget: int = 3000


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def bounded(text: str, most: int) -> Result:
    """A text of at most so many characters: its head and tail, with a note between them that tells exactly how many are left out."""
    if len(text) <= most:
        return Result(True, text)
    note, keep = "", most
    # The number's own width matters: the first keep that agrees with its note, from the largest on.
    for width in range(1, len(str(len(text))) + 1):
        keep = most - len(f"\n\n... [{'9' * width} chars omitted; showing head and tail] ...\n\n")
        if keep >= 0 and len(str(len(text) - keep)) == width:
            note = f"\n\n... [{len(text) - keep} chars omitted; showing head and tail] ...\n\n"
            break
    if not note:
        return Result(True, text[:most], True)
    head = -(-keep // 2)
    return Result(True, text[:head] + note + (text[head - keep :] if keep > head else ""), True)


class Budget:
    """Whole rows until one doesn't fit."""

    def __init__(self, left: int):
        self.left, self.rows = left, []

    def push(self, row: str) -> bool:
        if tokens(row) > self.left:
            return False
        self.rows.append(row)
        self.left -= tokens(row)
        return True


def thousands(n: int) -> str:
    if n >= 10_000:
        return f"{n // 1000}k"
    return f"{n / 1000:.1f}k" if n >= 1000 else str(n)


class Repository:
    """A tree of source files below a root, parsed once and kept by path, size and time."""

    def __init__(self, spark: SparkSession, root: str, cache: str | None = None):
        self.spark, self.root = spark, root.rstrip("/") or "/"
        name = hashlib.sha256(self.root.encode()).hexdigest()[:16]
        self.features = tree.Features(spark, f"{cache or f'{shared_folder(spark)}/features'}/{name}", VERSION)
        self._rows: DataFrame | None = None

    def rows(self) -> DataFrame:
        """All files: doc_id, path, text, loc, tokens, entrypoint, changed, definitions, symbols, imports."""
        if self._rows is None:
            listed = tree.files(self.spark, self.root)
            found = self.features.refresh(listed, readers.parse)
            changed = history.changed(found.select("path"), self.root.removeprefix("file://")).withColumn("changed", F.lit(True))
            rows = found.join(changed, "path", "left").withColumns({"doc_id": F.xxhash64("path"), "changed": F.coalesce("changed", F.lit(False)), "tokens": T.token_estimate(F.col("text"))})
            self._rows = stored(rows, "files")
        return self._rows

    def references(self, rows: DataFrame, named: list[str] = ()) -> DataFrame:
        symbols = rows.select("doc_id", F.explode("symbols").alias("symbol"))
        first = self.spark.createDataFrame([(s,) for s in named], "symbol string") if named else None
        return G.references(rows, G.definers(symbols), named=first)

    def listing(self, most_chars: int = 12_000) -> Result:
        """Every file as a section: entry points first, then the longest."""
        rows = self.rows()
        if not rows.limit(1).count():
            return Result(False, NO_FILES, exit_code=1)
        sections = rows.join(O.full_section(rows, self.references(rows)), "doc_id").orderBy(F.desc("entrypoint"), F.desc("loc"), "path").select("section")
        out, size = [], 0
        for r in sections.toLocalIterator():
            out.append(r["section"])
            size += len(r["section"])
        return self._ended("".join(out), most_chars)

    def _ended(self, text: str, most_chars: int) -> Result:
        done = Result(True, NOTHING_FITS) if not text else bounded(text, max(1, most_chars))
        done.exit_code = 0
        return done

    def task_map(self, task: Task, most_chars: int = 60_000, compact: bool = False, most_files: int = MOST_FILES) -> Result:
        """The best files for a task, as sections (or lines) that fit the budget."""
        every = self.rows()
        n = every.count()
        if not n:
            return Result(False, NO_FILES, exit_code=1)
        none = F.array().cast("array<string>")
        listed = lambda values: F.array(*map(F.lit, values)) if values else none
        context = self.spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(task.query).alias("query"), *(listed(v).alias(c) for c, v in (("mentioned_paths", task.mentioned_paths), ("mentioned_symbols", task.mentioned_symbols), ("open_paths", task.open_paths))))
        rows = every
        if n > most_files:
            rows = every.join(R.shortlist(every, context, most_files).select("doc_id"), "doc_id", "left_semi")
        refs = stored(self.references(rows, task.mentioned_symbols), "refs")
        scores = R.with_prior(R.bm25(rows, context.select("query_id", "query")), rows) if task.query else self.spark.createDataFrame([], "query_id long, doc_id long, score double")
        prior = rows.select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.when(F.col("changed"), 2.0).otherwise(0.0).alias("prior"))
        tier = R.tiers(rows, context, G.unique_callers(refs.where(F.col("symbol").isin(*task.mentioned_symbols)) if task.mentioned_symbols else refs.limit(0)))
        scored = prior.join(scores, ["query_id", "doc_id"], "left").join(tier, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", "prior").alias("score"), F.coalesce("tier", F.lit(0)).alias("tier"))
        section = O.compact_line(rows).select("doc_id", F.concat("line", F.lit("\n")).alias("section")) if compact else O.full_section(rows, refs)
        section = stored(section.withColumn("tokens", T.token_estimate(F.col("section"))), "sections")
        ordered = R.total_order(scored.join(rows.select("doc_id", "path", "loc", "entrypoint"), "doc_id").join(section.select("doc_id", "tokens"), "doc_id"))
        packed = R.pack_skip(ordered, "query_id", task.budget).join(section, "doc_id").orderBy("pos").select("section").collect() if task.budget else []  # as much as the budget holds
        text = "".join(r["section"] for r in packed)
        if text and n > most_files:
            text += f"\n... [query shortlist indexed {most_files} of {n} source files; name a path or symbol to reach others]\n"
        return self._ended(text, most_chars)

    def packages(self) -> DataFrame:
        """directory of every folder of the tree with a manifest and source files below it; the root is empty."""
        home = T.parent(F.col("path"))
        parts = F.split(home, "/")
        above = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
        found = [(p.rpartition("/")[0],) for p in tree._named(self.spark, self.root, D.MANIFESTS)]
        held = self.spark.createDataFrame(found, "directory string").distinct()
        return self.rows().select(F.explode(above).alias("directory")).distinct().join(held, "directory")

    def overview(self, budget: int = 2000, most_chars: int = 12_000, name: str | None = None) -> Result:
        """What a tree is, how to build it, where things are and what the rest depends on."""
        rows = self.rows()
        n, lines = rows.agg(F.count("*"), F.sum("loc")).first()
        if not n:
            return Result(False, NO_FILES, exit_code=1)
        folder, out = D.Folder(self.spark, self.root), Budget(budget)
        packages = stored(self.packages(), "packages")
        out.push(f"# {name or self.root.rpartition('/')[2]}: repository overview ({n} source files, {thousands(lines)} lines)\n")
        said = D.purpose_of_tree(folder)
        out.push("\n## Purpose\n" + ("(no README)" if said is None else (f"{said[0]}: " if said[0] else "") + (said[1] or "(README has no summary paragraph)")) + "\n")
        mix = O.language_mix(rows.withColumn("language", T.language(F.col("path")))).collect()  # six rows
        out.push("\n## Stack\n" + " · ".join(f"{r['language']} {r['percent']}% ({r['files']} files)" for r in mix) + "\n")
        roots = sorted(r["directory"] for r in packages.collect())  # a row for each package
        steps = [c for d in ["", *(d for d in roots if d)] for c in D.commands(folder, d)]
        if steps and out.push("\n## Build and test\n"):
            if all(out.push(f"- {c}\n") for c in steps[:8]) and len(steps) > 8:
                out.push(f"- ... {len(steps) - 8} more manifests\n")
        self._layout(out, rows, packages, folder)
        entries = O.entry_points(rows, packages).where(~T.test_like(F.col("path"))).orderBy("depth", F.desc("loc"), F.split("path", "/")).limit(10)
        entries = entries.join(rows.select("doc_id", "definitions"), "doc_id").orderBy("depth", F.desc("loc"), F.split("path", "/")).collect()
        if entries and out.push("\n## Entry points\n"):
            for r in entries:
                if not out.push(f"{r['path']} | {r['loc']} LOC" + (f" | {'; '.join(r['definitions'][:5])}" if r["definitions"] else "") + "\n"):
                    break
        refs = self.references(rows) if n <= MOST_FILES else rows.sparkSession.createDataFrame([], "doc_id long, symbol string, owner long")
        central = O.central(rows, refs).join(rows.select(F.col("doc_id").alias("owner"), "loc", "definitions"), "owner").orderBy(F.desc("users"), "path").collect()  # eight rows
        if central and out.push("\n## Central files (used by the most other files)\n"):
            for r in central:
                types = [x for x in r["definitions"][:24] if x.split(" ")[0] in O.TYPE_KINDS][:6]
                if not out.push(f"{r['path']} | {r['loc']} LOC | used by {r['users']} files" + (f" | {'; '.join(types)}" if types else "") + "\n"):
                    break
        self._index(out, rows, n)
        done = bounded("".join(out.rows), max(1, most_chars))
        done.exit_code = 0
        return done

    def _layout(self, out: Budget, rows: DataFrame, packages: DataFrame, folder: D.Folder) -> None:
        groups = O.layout(rows, packages).orderBy(F.desc("loc"), "directory")
        shown = groups.collect()  # as many rows as a layout has
        held = O.owners(rows, self.spark.createDataFrame([(r["directory"],) for r in shown], "directory string"))
        held = rows.join(held, "doc_id").select("owner", "path", "loc", O.substantive(F.col("definitions")).alias("class"))
        k = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("class"), F.desc("loc"), "path"))
        root = F.regexp_extract("path", "[^/]*$", 0).isin(*D.MODULE_ROOTS)
        counts = held.groupBy("owner", T.parent(F.col("path")).alias("home")).agg(F.count("*").alias("n")).collect()  # a row for each directory
        modules = held.where(root).select("owner", "path").collect()  # at most as many rows as directories have such names
        best = held.withColumn("k", k).where(F.col("k") <= 4).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("k", "path"))).alias("top")).collect()
        best = {r["owner"]: [x["path"] for x in r["top"]] for r in best}
        areas = D.find_areas(self.spark, self.root)
        if not out.push("\n## Layout (directory | files | lines | purpose | largest files)\n"):
            return
        for r in shown:
            d = r["directory"]
            why = None
            if areas is not None:
                inside = areas.inside(d, {c["home"]: c["n"] for c in counts if c["owner"] == d})
                why = areas.covering(d) or (f"areas: {', '.join(inside)}" if inside else None)
            why = why or D.directory_purpose(folder, d, [m["path"] for m in modules if m["owner"] == d]) or ""
            names = ", ".join(p.removeprefix(f"{d}/") for p in best.get(d, []))
            if not out.push(f"{f'{d}/' if d else '(top level)'} | {r['files']} | {thousands(r['loc'])} | {why}{' | ' if why else ''}e.g. {names}\n"):
                break

    def _index(self, out: Budget, rows: DataFrame, n: int) -> None:
        """All directories with as many names as fit: the largest number by halving, each tried by a sum over directories."""
        after = "\nNext: ask again with the task in plain words to rank the files for it, or map one directory in more detail.\n"
        head = "\n## Files (directory (count, extension): names, largest first; +N not shown)\n"
        room = out.left - tokens(after) - tokens(head)
        if room > 40:
            size = lambda cap: -(-(O.directories(rows, cap).agg(F.sum(F.length("line") + 1)).first()[0]) // 4)
            low, high = 1, n
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if size(mid) <= room else (low, mid - 1)
            text, order = "", O.directories(rows, low).orderBy(F.desc("loc"), "directory")
            for r in order.toLocalIterator():
                if tokens(text + r["line"] + "\n") > room:
                    break
                text += r["line"] + "\n"
            if text:
                out.push(head)
                out.push(text)
        out.push(after)
