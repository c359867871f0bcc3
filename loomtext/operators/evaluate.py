"""Evaluation of rankings: metrics, grouped reports, percentiles, bootstrap, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from .ranking import _lists, _spread
from .tables import stored

#: Passages up to which they go to every task.
MOST_PASSAGES = 100_000
#: First bytes of a passage by which places are found, bytes of text looked at in one step, and the base of their hash.
WINDOW, BLOCK, BASE = 16, 1 << 18, 0x9E3779B97F4A7C15
#: Words of a passage, between its first and its last, by which documents that may hold it are found.
RUN = 4


def holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, doc_id of the documents (doc_id, text) whose text contains a passage (query_id, passage; a stated set).

    One pass over the texts: a rolling hash of their bytes tells where a passage
    may begin, and the bytes there decide. Only what is found is moved.
    """
    rows = passages.where("passage is not null").select("query_id", "passage").limit(MOST_PASSAGES + 1).collect()  # a row for each query
    if len(rows) > MOST_PASSAGES:
        return holders_joined(docs, passages)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    run = _holding([r["query_id"] for r in rows], [r["passage"].encode() for r in rows])
    return docs.select("doc_id", "text").mapInArrow(run, f"query_id {kind(passages, 'query_id')}, doc_id {kind(docs, 'doc_id')}").distinct()


def _holding(ids: list, passages: list[bytes]):
    def powers(base):
        import numpy as np

        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(BLOCK + WINDOW, base, dtype="uint64")])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        up, down = powers(BASE), powers(pow(BASE, -1, 1 << 64))

        def hashes(data, size):
            """Of every so many bytes in a row."""
            total = np.zeros(len(data) + 1, dtype="uint64")
            np.cumsum(data * up[: len(data)], out=total[1:])
            return (total[size:] - total[: len(total) - size]) * down[: len(total) - size]

        long = np.array([len(x) for x in passages], dtype="int64")
        sizes = []
        for size in sorted({min(len(x), WINDOW) for x in passages}):
            own = [k for k, x in enumerate(passages) if min(len(x), WINDOW) == size]
            key = [hashes(np.frombuffer(passages[k][:size], dtype="uint8"), size)[0] for k in own]
            keys, at = np.unique(np.array(key, dtype="uint64"), return_inverse=True)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(keys >> np.uint64(48)).astype("int64")] = True
            sizes.append((size, keys, seen, _lists(list(zip(at.tolist(), own)), len(keys))))
        for b in batches:
            data, rows = W.raw(b.column(1))
            text, pairs = data.tobytes(), {}
            for size, keys, seen, lists in sizes:
                if not size:
                    pairs |= {(r, p): rows[r] for r in range(b.num_rows) for p in lists[1].tolist()}
                for start in range(0, len(data) - size + 1 if size else 0, BLOCK):
                    h = hashes(data[start : start + BLOCK + size - 1], size)
                    at = np.flatnonzero(seen[(h >> np.uint64(48)).astype("int64")])
                    k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                    at, k = at[keys[k] == h[at]], k[keys[k] == h[at]]
                    each, p = _spread(lists, k)
                    at = start + at[each]
                    r = np.searchsorted(rows, at, "right") - 1
                    fits = at + long[p] <= rows[r + 1]
                    _, first = np.unique(r[fits] * len(passages) + p[fits], return_index=True)
                    for x in np.flatnonzero(fits)[first].tolist():
                        pairs.setdefault((int(r[x]), int(p[x])), int(at[x]))
            found = [(r, p) for (r, p), at in pairs.items() if text.find(passages[p], at, rows[r + 1]) >= 0]
            doc, query = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids).take(query), "doc_id": b.column(0).take(doc)})

    return run


def holders_joined(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """holders for passages too many to go to every task.

    A document that holds a passage also holds its inner words, whole and in a
    row: an equi-join on a run of them finds candidates, which are then compared.
    Passages of fewer words are found by their first bytes only if there are any.
    """
    words = lambda c: F.split(c, "[ \n]+")
    long = F.size(words("passage")) >= RUN + 2
    keyed = passages.where(long).select("query_id", "passage", F.array_join(F.slice(words("passage"), 2, RUN), " ").alias("key"))
    # Words beside those after them, so that a text is split once and not for each of its words.
    cut = docs.select("doc_id", words("text").alias("w0"))
    side = F.arrays_zip("w0", *(F.slice("w0", k + 1, 1 << 30).alias(f"w{k}") for k in range(1, RUN)))
    runs = cut.select("doc_id", F.explode(side).alias("z")).select("doc_id", F.concat_ws(" ", *(F.col(f"z.{c}") for c in [f"w{k}" for k in range(RUN)])).alias("key"))
    pairs = runs.join(keyed.select("query_id", "key"), "key").select("doc_id", "query_id").distinct()
    found = docs.join(pairs, "doc_id").join(passages, "query_id").where(F.col("text").contains(F.col("passage"))).select("query_id", "doc_id")
    short = passages.where(~long)
    if short.limit(1).count():
        block = short.agg(F.collect_list(F.struct("query_id", "passage")).alias("block"))
        rest = docs.crossJoin(F.broadcast(block)).select("doc_id", F.explode(F.filter("block", lambda x: F.col("text").contains(x["passage"]))["query_id"]).alias("query_id"))
        found = found.union(rest.select("query_id", "doc_id"))
    return found.distinct()


#: Ranks that metrics look at.
DEPTH = 20


def metrics(ranked: DataFrame, gold: DataFrame, depth: int = DEPTH) -> DataFrame:
    """query_id, ndcg10, r1, r5, r10, mrr (6 digits) of every query with gold; one without a hit has zeros."""
    want = gold.groupBy("query_id").agg(F.count("*").alias("n"))
    hit = ranked.where(F.col("rank") <= depth).join(gold, ["query_id", "doc_id"])
    at = lambda k, v: F.sum(F.when(F.col("rank") <= k, v).otherwise(0.0))
    got = hit.groupBy("query_id").agg(at(10, 1 / F.log2(F.col("rank") + 1)).alias("dcg"), *(at(k, F.lit(1.0)).alias(f"h{k}") for k in (1, 5, 10)), F.min("rank").alias("best"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return want.join(got, "query_id", "left").select(
        "query_id", F.round(zero(F.col("dcg")) / ideal, 6).alias("ndcg10"), *(F.round(zero(F.col(f"h{k}")) / F.col("n"), 6).alias(f"r{k}") for k in (1, 5, 10)), F.round(zero(1 / F.col("best")), 6).alias("mrr")
    )


def grouped(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """Means over all rows and by each of the columns, as one table."""
    sets = [results.groupBy(F.lit("all").alias("kind"), F.lit("").alias("key"))] + [results.groupBy(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in by]
    out = None
    for s in sets:
        one = s.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
        out = one if out is None else out.union(one)
    return out


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, doc_id, score (6 digits) of ranked lists (query_id, doc_id, place from 0, weight)."""
    return lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("place"))), 6).alias("score"))


def bootstrap(results: DataFrame, value: str, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """mean, low, high: the 95 % interval of the mean of a few rows (one for each evaluated query), drawn in the order of query_id."""
    import random

    x, rng = [r[value] for r in results.select("query_id", value).orderBy("query_id").collect()], random.Random(seed)
    if not x:
        return results.sparkSession.createDataFrame([], "mean double, low double, high double")
    means = sorted(sum(rng.choice(x) for _ in x) / len(x) for _ in range(rounds))
    return results.sparkSession.createDataFrame([(sum(x) / len(x), means[int(0.025 * rounds)], means[int(0.975 * rounds)])], "mean double, low double, high double")


def paired(base: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """query_id, delta of the queries that both have."""
    return base.select("query_id", F.col(value).alias("a")).join(other.select("query_id", F.col(value).alias("b")), "query_id").select("query_id", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def win_tie_loss(deltas: DataFrame) -> DataFrame:
    """n, mean, wins, ties, losses, with a band of 1e-9 for ties."""
    d = F.col("delta")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return deltas.agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean"), count(d > 1e-9, "wins"), count(F.abs(d) <= 1e-9, "ties"), count(d < -1e-9, "losses"))


def macro_mean(results: DataFrame, by: str, value: str) -> DataFrame:
    """macro: the mean of the groups' means."""
    return results.groupBy(by).agg(F.avg(value).alias("m")).agg(F.round(F.avg("m"), 6).alias("macro"))


def nearest_rank(rows: DataFrame, value: str, share: float) -> DataFrame:
    """value_at: the element at place int(share * n) of the sorted values.

    Equal values are counted together first. Slices of the value range are
    summed before the one slice with the place is sorted, so no task gets all.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    parts = counts.repartitionByRange(value).withColumn("part", F.spark_partition_id())
    parts = stored(parts, "values")
    sizes = sorted((r["low"], r["part"], r["n"]) for r in parts.groupBy("part").agg(F.min(value).alias("low"), F.sum("n").alias("n")).collect())  # a row for each part
    total = sum(n for *_, n in sizes)
    place = min(total - 1, int(share * total))
    for _, part, n in sizes:
        if place < n:
            upto = F.sum("n").over(Window.orderBy(value))
            return parts.where(F.col("part") == part).withColumn("upto", upto).where(F.col("upto") > place).agg(F.min(value).alias("value_at"))
        place -= n
    return counts.select(F.col(value).alias("value_at")).limit(0)


def hot_files(cases: DataFrame, depth: int = 20) -> DataFrame:
    """id, path, n, place: for each case the files that most other cases of its repository have as gold. cases: id, repo, gold (array)."""
    each = cases.select("id", "repo", F.explode("gold").alias("path"))
    total = each.groupBy("repo", "path").agg(F.count("*").alias("n"))
    # Others' count is the total less one's own; only the first depth and as many as a case has gold can matter.
    widest = cases.agg(F.coalesce(F.max(F.size("gold")), F.lit(0))).first()[0]
    k = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "path"))
    top = total.withColumn("k", k).where(F.col("k") <= depth + widest).drop("k")
    own = each.select("id", "repo", "path", F.lit(1).alias("own"))
    # Files of a case itself may be in the list only through others, and one that drops by its own count may fall behind any with one less.
    rows = cases.select("id", "repo").join(top, "repo").join(own, ["id", "repo", "path"], "left").select("id", "path", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "path"))
    return rows.withColumn("place", place).where(F.col("place") <= depth)


#: Vectors of a block, and queries of one: a pair's scores are one product of two matrices, of 32 MB at most.
VECTORS, QUERIES = 4096, 1024
#: Blocks of queries whose best files a task holds at a time.
HELD = 256
#: Scores as whole millionths: not a number, none (a vector is null, or of another length), no file.
NAN, NONE, ABSENT = 3_000_000, -3_000_000, -4_000_000


def _blocks(most: int):
    """Rows (id, list of doubles) as rows (dim, ids, vectors): matrices of up to `most` unit vectors of one length, in order of id. Null ones, and those with null elements, have the length 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept: dict[int, list] = {}

        def block(dim, k):
            rows = sorted(kept[dim][:k], key=lambda r: r[0])
            kept[dim] = kept[dim][k:]
            v = np.array([r[1] for r in rows], dtype="float64").reshape(len(rows), dim)
            with np.errstate(all="ignore"):
                v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array([r[0] for r in rows], dtype="int64").tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary())})

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                dim = 0 if x is None else len(x)
                kept.setdefault(dim, []).append((i, () if x is None else x))
                if len(kept[dim]) == most:
                    yield block(dim, most)
        for dim in kept:
            if kept[dim]:
                yield block(dim, most)

    return run


def _best(most: int):
    """Pairs of a block of vectors and one of queries (k tells which) as rows (query_id, file, score): each query's best files of all that the task sees."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def told(ids, score, file):
            at = score > ABSENT
            s = score[at]
            value = np.where(s == NAN, np.nan, s / 1e6)
            return pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(ids, at.sum(axis=1))), "file": pa.array(file[at]), "score": pa.array(value, mask=s == NONE)})

        held: dict[int, tuple] = {}
        for b in batches:
            for r in b.to_pylist():
                ids, files = np.frombuffer(r["query_ids"], dtype="int64"), np.frombuffer(r["ids"], dtype="int64")
                first = np.flatnonzero(np.r_[True, files[1:] != files[:-1]])
                files = files[first]
                if r["dim"] and r["dim"] == r["query_dim"]:
                    q, v = (np.frombuffer(r[c], dtype="float64").reshape(-1, r["dim"]) for c in ("queries", "vectors"))
                    with np.errstate(all="ignore"):
                        x = np.maximum.reduceat(q @ v.T, first, axis=1) * 1e6
                        x = np.where(np.isnan(x), NAN, np.trunc(x + np.copysign(0.5, x))).astype("int64")
                else:
                    x = np.full((len(ids), len(files)), NONE, dtype="int64")
                # One number holds score and place by file, so that one selection respects both.
                n = len(files)
                key = x * n + np.arange(n - 1, -1, -1)
                if n > most:
                    key = np.partition(key, n - most, axis=1)[:, n - most :]
                score, file = key // n, files[n - 1 - key % n]
                if r["k"] in held:
                    _, s, f = held.pop(r["k"])
                    score, file = np.hstack([score, s]), np.hstack([file, f])
                    # A file that both have keeps its better score.
                    by = np.lexsort((-score, file), axis=1)
                    score, file = np.take_along_axis(score, by, 1), np.take_along_axis(file, by, 1)
                    score[:, 1:][file[:, 1:] == file[:, :-1]] = ABSENT
                    by = np.lexsort((file, -score), axis=1)[:, :most]
                    score, file = np.take_along_axis(score, by, 1), np.take_along_axis(file, by, 1)
                held[r["k"]] = ids, score, file
                if len(held) > HELD:
                    yield told(*held.pop(next(iter(held))))
        for x in held.values():
            yield told(*x)

    return run


def best_chunks(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """query_id, file, score (6 digits), place: a file's score is the highest cosine of its chunks. vectors: file, embedding; queries: query_id, embedding, a stated set (ids are long).

    Blocks of queries stand beside blocks of vectors; a task keeps the best
    `most` files of each query of what it sees, and only these are moved. A file
    among a query's best is among them wherever its best chunk is, so none is
    lost. A null vector, or one of another length, has no score; a vector of
    zeros has NaN, above all others, as in SQL.
    """
    wide = lambda df, key: df.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "dim int, ids binary, vectors binary"
    a, b = wide(vectors, "file").mapInArrow(_blocks(VECTORS), schema), wide(queries, "query_id").mapInArrow(_blocks(QUERIES), schema)
    b = stored(b.select(F.monotonically_increasing_id().alias("k"), F.col("dim").alias("query_dim"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")), "blocks")
    pairs = a.repartition(3 * max(8, vectors.sparkSession.sparkContext.defaultParallelism)).crossJoin(F.broadcast(b))
    best = pairs.mapInArrow(_best(most), "query_id long, file long, score double").groupBy("query_id", "file").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "file"))
    return best.withColumn("place", place).where(F.col("place") <= most)


def capped_cases(cases: DataFrame, most_per_file: int = 6, most_cases: int = 1_000_000) -> DataFrame:
    """id, repo, pos: cases in the order of their digest, without those of which a gold file already has its share. One pass over each repository, in order; state is a count for each file."""

    def run(pdf):
        import pandas as pd

        seen, out = {}, []
        for r in pdf.sort_values("digest").itertuples():
            if len(out) >= most_cases:
                break
            if any(seen.get(g, 0) >= most_per_file for g in r.gold):
                continue
            for g in r.gold:
                seen[g] = seen.get(g, 0) + 1
            out.append((r.id, r.repo, len(out)))
        return pd.DataFrame(out, columns=["id", "repo", "pos"])

    # A repository's commits are one group: the choice is sequential, and rows are ids and paths only.
    return cases.select("id", "repo", "gold", "digest").groupBy("repo").applyInPandas(lambda pdf: run(pdf), "id string, repo string, pos int")


def audited(cases: DataFrame, labels: DataFrame, fair: str) -> DataFrame:
    """cases that a review calls fair. Fails unless every case has exactly one label, and every label a case. cases: id, …; labels: id, label."""
    n = labels.groupBy("id").agg(F.count("*").alias("n"), F.max("label").alias("label"))
    bad = cases.select("id", F.lit(1).alias("here")).join(n, "id", "full").where("here is null or n is null or n <> 1").limit(10).collect()
    if bad:
        raise ValueError(f"labels do not cover the cases exactly once: {sorted(str(r['id']) for r in bad)}")
    return cases.join(n.where(F.col("label") == fair).select("id"), "id")


# Fixed value: a file's line in a map.
MAP_LINE = r"^(\S[^|]*?) \| \d+ LOC(?: \|.*)?$"


def ranked_paths(outputs: DataFrame, maps: bool = True, depth: int = 20) -> DataFrame:
    """query_id, path, rank: the first distinct paths of each output (query_id, output, root). maps: of map lines only, else every line is a path. Paths are made relative to the root and normal."""
    line = F.transform(F.split("output", "\n"), lambda x: F.regexp_extract(x, MAP_LINE, 1) if maps else T.normal_space(x))
    inside = lambda p: F.when(p.startswith(F.concat("root", F.lit("/"))), F.substring(p, F.length("root") + 2, F.length(p))).otherwise(p)
    paths = F.array_distinct(F.transform(F.filter(line, lambda p: p != ""), lambda p: T.normal_path(inside(F.translate(p, "\\", "/")))))
    return outputs.select("query_id", F.posexplode(F.slice(paths, 1, depth)).alias("rank", "path")).select("query_id", "path", (F.col("rank") + 1).alias("rank"))


def name_sets(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """kind, both, ours_only, theirs_only, precision, recall of two sets of definitions (path, kind, name)."""
    key = ["path", "kind", "name"]
    rows = ours.select(*key).distinct().withColumn("a", F.lit(1)).join(theirs.select(*key).distinct().withColumn("b", F.lit(1)), key, "full")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    sums = rows.groupBy("kind").agg(n(F.col("a").isNotNull() & F.col("b").isNotNull(), "both"), n(F.col("b").isNull(), "ours_only"), n(F.col("a").isNull(), "theirs_only"))
    part = lambda other: F.round(F.try_divide("both", F.col("both") + F.col(other)), 6)
    return sums.select("*", part("ours_only").alias("precision"), part("theirs_only").alias("recall"))


def orientation(answers: DataFrame, cases: DataFrame, by: str, most: int = 5) -> DataFrame:
    """by, n, recall, dir_hit: means of the share of gold files among the first answers (id, path, place), and of whether one of these is in a directory of a gold file. cases: id, gold, by; those without answers count as 0."""
    top = answers.where(F.col("place") <= most).groupBy("id").agg(F.collect_set("path").alias("paths"))
    rows = cases.select("id", "gold", by).join(top, "id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    homes = lambda x: F.transform(x, T.parent)
    recall = F.size(F.array_intersect("gold", "paths")) / F.size("gold")
    hit = F.arrays_overlap(homes("gold"), homes("paths")).cast("double")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(recall), 6).alias("recall"), F.round(F.avg(hit), 6).alias("dir_hit"))
