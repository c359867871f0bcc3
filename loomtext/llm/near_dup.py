"""Near-duplicate classes: consistent weighted sampling, banding, weighted Jaccard.

A document is the multiset of its runs of five words (all its words, if fewer).
A shingle weighs its count times an inverse document frequency, ``1 + IDF_PART *
ln(min(N / df, RARE))``: shingles in under 1 of ``RARE`` documents all count as
rare, so that a few copies of a text don't outweigh its edits.

1. *Document frequencies*, exact. Only shingles in more than 1 of ``RARE``
   documents need theirs. A first pass counts documents by cell of a hash, all
   of them; a frequent shingle's cell counts as much as it does, at least. A
   second pass counts the shingles of such cells, and the cut applies to the
   totals. No more than RARE times the mean number of shingles of a document
   can be frequent, whatever the size of the corpus: that table is broadcast.
2. *Samples.* Consistent weighted sampling, ``BANDS * ROWS`` samples of the whole
   text. A weight is a number of copies of a shingle, each of a weight that is
   the same in all texts; a copy's clock runs down exponentially at the rate of
   that weight, and the first is the sample. Two texts agree in a sample with a
   probability of their weighted Jaccard similarity, exactly, however uneven the
   weights are, and independently of other samples.
3. *Links.* Documents that agree in all bins of a band meet. Texts with the same
   shingles are one before that. In each bucket every document is first compared
   with the hub, the one that meets most others over all bands: in a group of
   edited copies that is the text they were made from, or one close to it. Then
   every two that meet and are of different classes so far are compared, in the
   first band where they meet: the texts of a bucket fall into blocks, and each
   two blocks that aren't of one class are a unit of work, so that a crowded
   bucket spreads over many tasks. A unit gives one link for two classes, not
   one for each pair of their texts.
4. *Verification* with the weighted Jaccard similarity of the whole multisets,
   then classes as connected components, by joins that halve distances. The
   classes are those of all verified pairs that meet; only links that made a
   class are counted, not all pairs inside of it.

Null texts read as empty. Texts without words are alike only if equal: a class
each by text. Equal texts of repeated rows, equal or null ids are one class. The
class id is the smallest doc_id of the class (null if it has none). An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkit import BASE, Words, buffers, column, mix, slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
IDF_PART, RARE = 0.25, 100
#: Shingles that a task holds before it adds up their document frequencies.
COUNTED = 2_000_000
#: Cells of the first count, and those in a row of it.
CELLS, CHUNK = 1 << 20, 1 << 12
#: Bytes of shingles and counts (12 each) of the texts of a block, about.
BLOCK = 1 << 20


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of each text's distinct shingles, in order of both, and the number of texts."""
    words = Words(*buffers(texts))
    h, text = words.grams(SHINGLE)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.zeros(0, np.int64)
    return text[at], h[at], np.diff(np.append(at, len(h)))


class Weights:
    """Weights of shingles: counts times inverse document frequencies. frequent: sorted hashes, df: their frequencies as shares of all documents."""

    def __init__(self, frequent: np.ndarray, share: np.ndarray):
        order = np.argsort(frequent)
        self.frequent = frequent[order]
        self.idf = 1 + IDF_PART * np.log(np.minimum(1 / np.maximum(share[order], 1e-12), RARE))
        self.rare = 1 + IDF_PART * np.log(RARE)

    def of(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        idf = np.full(len(h), self.rare)
        if len(self.frequent):
            at = np.searchsorted(self.frequent, h)
            at[at == len(self.frequent)] = 0
            hit = self.frequent[at] == h
            idf[hit] = self.idf[at[hit]]
        return count * idf


def _salt(k: int) -> np.uint64:
    return np.uint64(k * int(BASE) % 2**64)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + _salt(salt)) >> np.uint64(11)).astype(np.float64) * 2**-53 + 2**-54


def samples(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, draws: int = BANDS * ROWS, count: np.ndarray | None = None) -> np.ndarray:
    """Per text so many samples of all its shingles, each as one 64-bit number; texts without shingles have zeros. text: ascending. weight: of a copy, the same to the bit in all texts. count: copies, 1 each if not given."""
    out = np.zeros((n, draws), np.uint64)
    if not len(h):
        return out
    at = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    if count is None:
        copy, rate, first = h, weight, at
    else:
        begin = np.cumsum(count) - count
        nth = np.arange(count.sum()) - np.repeat(begin, count)
        copy, rate, first = mix(np.repeat(h, count) + nth.astype(np.uint64) * BASE), np.repeat(weight, count), begin[at]
    scale = -1 / rate
    for k in range(draws):
        # A clock tells its copy: others show the same time with a probability of about 2**-53.
        clock = np.minimum.reduceat(np.log(_uniform(copy, 1001 + k)) * scale, first)
        out[text[at], k] = mix(clock.view(np.uint64))
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    """Per text a key for each band."""
    groups = sample.reshape(len(sample), BANDS, ROWS)
    key = np.zeros((len(sample), BANDS), np.uint64)
    for j in range(ROWS):
        key = key * BASE + groups[:, :, j]
    return mix(key + np.arange(1, BANDS + 1, dtype=np.uint64))


def similarity(a: dict[int, float], b: dict[int, float]) -> float:
    """Weighted Jaccard similarity of weights by shingle."""
    top = sum(min(w, b.get(k, 0.0)) for k, w in a.items())
    total = sum(a.values()) + sum(b.values()) - top
    return top / total if total else 1.0


def _cell(h: np.ndarray) -> np.ndarray:
    return (mix(h + _salt(7)) % np.uint64(CELLS)).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by cell of their shingles, as chunks of the counts."""
    total = np.zeros(CELLS, np.int64)
    for part in slices(batches):
        _, h, _ = shingles(column(part, "text"))
        np.add.at(total, _cell(h), 1)
    for k in np.flatnonzero(total.reshape(-1, CHUNK).any(axis=1)).tolist():
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k * CHUNK : (k + 1) * CHUNK].astype(np.uint32).tobytes()])], ["chunk", "counts"])


def _full(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Cells with more than 1 of RARE documents; all rows of a chunk are here."""
    total: dict[int, np.ndarray] = {}
    for part in batches:
        for k, raw in zip(column(part, "chunk").to_pylist(), column(part, "counts").to_pylist()):
            counts = np.frombuffer(raw, np.uint32).astype(np.int64)
            total[k] = total[k] + counts if k in total else counts
    for k, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(k * CHUNK + np.flatnonzero(counts * RARE > n))], ["cell"])


def _counted(batches: Iterator[pa.RecordBatch], full: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents by shingle of the full cells; a shingle may have several rows, which add up."""
    held, size = [], 0
    wanted = np.unpackbits(full).astype(bool)

    def settle():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    for part in slices(batches):
        _, h, _ = shingles(column(part, "text"))
        h = h[wanted[_cell(h)]]
        held.append(h)
        size += len(h)
        if size >= COUNTED:
            yield settle()
            held, size = [], 0
    if size:
        yield settle()


def weights(docs: DataFrame) -> Weights:
    """Inverse document frequencies over all documents."""
    n, text = docs.count(), docs.select("text")
    cells = text.mapInArrow(_cells, "chunk long, counts binary").repartition("chunk").mapInArrow(partial(_full, n=n), "cell long").toArrow()
    full = np.zeros(CELLS, bool)
    full[cells["cell"].to_numpy()] = True
    found = text.mapInArrow(partial(_counted, full=np.packbits(full)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * RARE > n).toArrow()
    return Weights(found["h"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy().astype(float) / max(n, 1))


SIGNED = "doc_id long, t long, s1 long, s2 long, keys array<long>"


def _signed(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    """Per document: two hashes of its weighted shingles (of its text, if it has no words), and its band keys."""
    for part in slices(batches):
        texts = column(part, "text")
        text, h, count = shingles(texts)
        n = part.num_rows
        keys = bands(samples(text, h, weights.of(h, np.ones(len(h))), n, count=count)).view(np.int64)
        # Sums over distinct shingles don't depend on their order.
        both = []
        data, off = buffers(texts)
        empty = np.bincount(text, minlength=n) == 0
        for salt in (71, 72):
            s = np.zeros(n, np.uint64)
            np.add.at(s, text, mix(mix(h + np.uint64(salt)) + count.astype(np.uint64)))
            for i in np.flatnonzero(empty).tolist():
                x = data[off[i] : off[i + 1]].astype(np.uint64)
                s[i] = mix((mix(x * np.uint64(257) + np.arange(len(x), dtype=np.uint64) * BASE + np.uint64(salt))).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(x)))[0]
            both.append(s.view(np.int64))
        rows = [None if e else k for e, k in zip(empty.tolist(), keys)]
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "t"), pa.array(both[0]), pa.array(both[1]), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "t", "s1", "s2", "keys"])


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n)


def _verified(batches: Iterator[pa.RecordBatch], weights: Weights, least: float) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "sb"):
        ok = []
        for x, y in zip(column(part, "sa").to_pylist(), column(part, "sb").to_pylist()):
            (ha, ca), (hb, cb) = _unpack(x), _unpack(y)
            wa, wb = weights.of(ha, ca), weights.of(hb, cb)
            _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
            top = np.minimum(wa[i], wb[j]).sum()
            ok.append(bool(top >= least * (wa.sum() + wb.sum() - top) - 1e-9))
        out = part.filter(pa.array(ok, pa.bool_()))
        yield out.select(["a1", "a2", "b1", "b2"])


def _linked(rows: list[dict], weights: Weights, least: float) -> pa.RecordBatch:
    """The alike of two blocks (sides 0 and 1), or inside one (side 0 only), of different roots, that meet in no earlier band."""
    sets = [_unpack(r["shingles"]) for r in rows]
    n, size, band = len(rows), np.array([len(h) for h, _ in sets]), rows[0]["band"]
    h, row = np.concatenate([h for h, _ in sets]), np.repeat(np.arange(n), size)
    w = weights.of(h, np.concatenate([c for _, c in sets]))
    total, first = np.bincount(row, w, n), np.append(0, np.cumsum(size))
    order = np.argsort(h, kind="stable")
    _, group, many = np.unique(h, return_inverse=True, return_counts=True)
    start = np.cumsum(many) - many
    row_o, w_o = row[order], w[order]
    side, keys = np.array([r["side"] for r in rows]), np.array([r["keys"][:band] for r in rows], np.int64).reshape(n, band)
    x = np.array([(r["s1"], r["s2"]) for r in rows])
    _, root = np.unique(np.array([(r["r1"], r["r2"]) for r in rows]), axis=0, return_inverse=True)
    root, place, crossed, out = root.ravel(), np.arange(n), bool(side.any()), []
    for i in range(n):
        other = (side > side[i] if crossed else place > i) & (root != root[i]) & ~(keys == keys[i]).any(axis=1)
        other &= np.minimum(total, total[i]) >= least * np.maximum(total, total[i]) - 1e-9
        if not other.any():
            continue
        g = group[first[i] : first[i + 1]]
        k = many[g]
        at = np.repeat(start[g] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        top = np.bincount(row_o[at], np.minimum(w_o[at], np.repeat(w[first[i] : first[i + 1]], k)), n)
        for j in np.flatnonzero(other & (top >= least * (total + total[i] - top) - 1e-9)).tolist():
            if root[j] != root[i]:  # one link makes the two classes one
                root[root == root[j]] = root[i]
                out.append(np.concatenate([x[i], x[j]])[None])
    found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(4)], ["a1", "a2", "b1", "b2"])


def _crossed(batches: Iterator[pa.RecordBatch], weights: Weights, least: float) -> Iterator[pa.RecordBatch]:
    """Links between blocks; the rows of two blocks stand together."""
    held, now = [], None
    for part in slices(batches, "shingles"):
        for r in part.to_pylist():
            if held and (r["band"], r["work"]) != now:
                yield _linked(held, weights, least)
                held = []
            now = r["band"], r["work"]
            held.append(r)
    if held:
        yield _linked(held, weights, least)


def _works(placed: DataFrame) -> DataFrame:
    """For rows (band, key, x, size, root): band, work, side, x, root, so that any two texts of a bucket with different roots meet in one work."""
    kin = placed.groupBy("band", "key", "root").agg(F.sum("size").alias("c"))
    sizes = kin.groupBy("band", "key").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("c") < BLOCK, F.col("c"))).alias("few")).where("roots > 1")
    kin = kin.join(sizes, ["band", "key"])
    # A large class has blocks of its own, small classes share some.
    large = F.col("c") >= BLOCK
    piece = F.when(large, F.pmod(F.xxhash64("x"), F.ceil(F.col("c") / BLOCK))).otherwise(-1 - F.pmod(F.xxhash64("root"), F.ceil(F.col("few") / BLOCK)))
    own = [F.when(large, F.col(f"root.{s}")).otherwise(0).alias(s) for s in ("s1", "s2")]
    blocks = scratch.written(placed.join(kin, ["band", "key", "root"]).select("band", "key", "x", "root", F.struct(*own, piece.alias("piece")).alias("block")), "blocks")
    ends = blocks.groupBy("band", "key", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    a = ends.select("band", "key", F.col("block").alias("l"), F.col("low").alias("l_low"), F.col("high").alias("l_high"))
    b = ends.select("band", "key", F.col("block").alias("r"), F.col("low").alias("r_low"), F.col("high").alias("r_high"))
    two = a.join(b, ["band", "key"]).where("l <= r and not (l_low = l_high and r_low = r_high and l_low = r_low)")
    two = two.select("band", "key", "l", "r", F.xxhash64("band", "key", "l", "r").alias("work"))
    sides = two.select("band", "key", "work", F.col("l").alias("block"), F.lit(0).alias("side")).union(two.where("l <> r").select("band", "key", "work", F.col("r").alias("block"), F.lit(1).alias("side")))
    return blocks.join(sides, ["band", "key", "block"]).select("band", "work", "side", "x", "root")


_PAIR = "a1 long, a2 long, b1 long, b2 long"


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.expr("named_struct('s1', a1, 's2', a2)").alias("a"), F.expr("named_struct('s1', b1, 's2', b2)").alias("b"))


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """Connected components of links (a, b), structs that can be ordered: (node, root), the smallest node of each. Rounds of joins until nothing changes."""
    edges = scratch.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        # Large star: larger neighbours of a node go to its smallest; small star: smaller ones go to the smallest of them.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        after = scratch.written(small.where("u <> v").select("u", "v").distinct(), name)
        scratch.remove(edges)
        # Done when each node has one link, to a node that has none of its own.
        ends = after.select("u", F.lit(1).alias("n")).union(after.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
        if not ends.groupBy("u").agg(F.sum("n").alias("own"), F.count("*").alias("all")).where("own > 1 or own = 1 and all > 1").limit(1).count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Per document: doc_id, class_id, n_links (verified links of its text to others), t (a hash of its text), root (tells classes apart, also those of one doc_id)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    idf = weights(docs)
    signed = scratch.written(docs.mapInArrow(partial(_signed, weights=idf), SIGNED), "signed")
    texts = signed.groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys"))
    spread = texts.where("keys is not null").select(F.struct("s1", "s2").alias("x"), F.posexplode("keys").alias("band", "key"))
    full = spread.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.written(spread.join(full, ["band", "key"]).select("x", "band", "key", "n"), "met")
    hubs = met.join(met.groupBy("x").agg(F.sum("n").alias("meets")), "x").groupBy("band", "key").agg(F.max(F.struct("meets", "x"))["x"].alias("hub"))
    stars = met.join(hubs, ["band", "key"]).where("x <> hub").select(F.greatest("hub", "x").alias("a"), F.least("hub", "x").alias("b"))
    stars = scratch.written(stars.distinct(), "stars")
    # Shingles of the texts that met others, once each.
    node = met.select("x.*").distinct()
    one = signed.join(node, ["s1", "s2"], "left_semi").groupBy("s1", "s2").agg(F.min(F.struct(_id("doc_id").alias("id"), "t")).alias("r"), F.first("keys").alias("keys")).select("s1", "s2", "keys", "r.id", "r.t")
    sets = docs.withColumn("id", _id("doc_id")).select("id", "t", "text").join(one, ["id", "t"]).select("s1", "s2", "keys", "text")
    sets = scratch.written(sets.mapInArrow(_sets, "s1 long, s2 long, keys array<long>, shingles binary").dropDuplicates(["s1", "s2"]), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("shingles").alias("sb"))
        flat = pairs.select(F.col("a.s1").alias("a1"), F.col("a.s2").alias("a2"), F.col("b.s1").alias("b1"), F.col("b.s2").alias("b2"))
        both = flat.join(right.hint("shuffle_merge"), ["b1", "b2"]).join(left.hint("shuffle_merge"), ["a1", "a2"])
        ok = both.select("a1", "a2", "b1", "b2", "sa", "sb").mapInArrow(partial(_verified, weights=idf, least=least), _PAIR)
        return _ends(ok)

    sure = scratch.written(verify(stars), "links")
    scratch.remove(stars)
    roots = components(sure)
    # What the stars left apart: any two texts of a bucket that are of different classes so far.
    size = sets.select(F.struct("s1", "s2").alias("x"), F.octet_length("shingles").cast("long").alias("size"))
    placed = met.join(size, "x").join(roots, F.col("x") == F.col("node"), "left").select("band", "key", "x", "size", F.coalesce("root", "x").alias("root"))
    placed = scratch.written(placed, "placed")
    scratch.remove(met)
    works = _works(placed).select("band", "work", "side", "x.s1", "x.s2", F.col("root.s1").alias("r1"), F.col("root.s2").alias("r2")).join(sets.hint("shuffle_merge"), ["s1", "s2"])
    works = works.repartition("band", "work").sortWithinPartitions("band", "work")
    more = scratch.written(_ends(works.mapInArrow(partial(_crossed, weights=idf, least=least), _PAIR)), "links")
    scratch.remove(placed, sets)
    links = sure.union(more)
    if more.limit(1).count():
        roots = components(links)
    degree = links.select(F.col("a").alias("x")).union(links.select(F.col("b").alias("x"))).groupBy("x").agg(F.count("*").alias("n_links"))
    known = roots.select(F.col("node").alias("x"), "root")
    inside = texts.select(F.struct("s1", "s2").alias("x"), "low").join(known, "x", "left").join(degree, "x", "left").select("x", "low", F.coalesce("root", "x").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    inside = scratch.written(inside, "inside")
    tops = inside.groupBy("root").agg(F.min("low").alias("class_id"))
    table = inside.join(tops, "root").select("x.s1", "x.s2", "class_id", "n_links", "root")
    return signed.select("doc_id", "t", "s1", "s2").join(table, ["s1", "s2"]).select("doc_id", "class_id", "n_links", "t", "root")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles and counts of texts, packed."""
    for part in slices(batches):
        text, h, count = shingles(column(part, "text"))
        cut = np.searchsorted(text, np.arange(1, part.num_rows))
        rows = [a.tobytes() + b.astype(np.uint32).tobytes() for a, b in zip(np.split(h, cut), np.split(count, cut))]
        yield pa.RecordBatch.from_arrays([*(column(part, c) for c in ("s1", "s2", "keys")), pa.array(rows, pa.binary())], ["s1", "s2", "keys", "shingles"])


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs with one of each class, the one with the smallest doc_id; of rows with equal ids and texts, the one whose columns have the smallest hash. All columns stay, whatever their names."""
    found = classes(docs, least)
    found = scratch.written(found.select(_id("doc_id").alias("id"), "t", "root"), "classes")
    first = found.groupBy("root").agg(F.min(F.struct("id", "t")).alias("r")).select("r.id", "r.t")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    name = dict(zip(docs.columns, inner))
    kept = docs.toDF(*inner).withColumns({"id": _id(name["doc_id"]), "t": F.xxhash64(F.coalesce(F.col(name["text"]), F.lit("")))}).join(first, ["id", "t"], "left_semi")
    if found.groupBy("id", "t").count().where("count > 1").limit(1).count():
        kept = kept.withColumn("h", F.xxhash64(*inner))
        kept = kept.join(kept.groupBy("id", "t").agg(F.min("h").alias("h")), ["id", "t", "h"], "left_semi").dropDuplicates(["id", "t"])
    return kept.select(*inner).toDF(*docs.columns)


def _id(name: str):
    return F.coalesce(F.col(name), F.lit(-(2**63)).cast("long"))
