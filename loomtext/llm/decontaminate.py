"""Benchmark decontamination with suffix arrays over the training words.

Each shard of the training documents (a slice of a task's texts) is turned into
a suffix array over its words: the places whose first words open some benchmark
suffix, in the order of the up to ``window`` words that follow. Every benchmark
suffix is then looked up by binary search. The rows between its lower and upper
bound are the verbatim matches. Matches whose place and item word go on together
make longer ones; the longest of a document is given with its place, its item
and its place in the item. The documents never move: there is no shuffle.

The benchmark is broadcast in blocks of at most about ``BLOCK_WORDS`` words, as
hashes of words and the places of suffixes: 20 bytes a word. Documents pass
through one block after another.

A window is ``window`` consecutive words of an item; an item of fewer words, but
not none, is one window. Null texts have no words. Repeated rows and equal or
null ids are separate documents; items that repeat count once by item_id, and
a null item_id counts as an empty one. Empty tables: no rows, or no hits. Of
equally long matches the one with the smallest item_id, then the first place
counts. Other columns are not read; rows that stay keep all of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import BASE, Words, buffers, column, mix, slices

WINDOW = 13
BLOCK_WORDS = 1_000_000
#: Words that open a suffix, at most; suffixes of fewer words are opened by all of theirs.
OPENING = 3


class TestSuffixes:
    """The windows of a block of benchmark items: where each begins among the hashes of all words, its size, its item and its place in it."""

    __test__ = False

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        words = Words(*buffers(texts))
        size = np.minimum(words.count, window)
        many = np.where(words.count > 0, words.count - size + 1, 0)
        self.names, self.window = ids, window
        self.item = np.repeat(np.arange(len(ids), dtype=np.int32), many)
        self.offset = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
        self.start = words.first[:-1][self.item] + self.offset
        self.size = size[self.item].astype(np.int32)
        self.hashes = words.hashes
        #: By number of words: the hashes of the openings of suffixes that have no more or OPENING.
        self.openings = {}
        for k in range(1, OPENING + 1):
            mine = self.start[(self.size >= k) if k == OPENING else (self.size == k)]
            if len(mine):
                self.openings[k] = np.unique(_opening(self.hashes, mine, k))

    def rows(self, which: np.ndarray, k: int) -> np.ndarray:
        """Word k of each of these windows."""
        return self.hashes[np.minimum(self.start[which] + k, len(self.hashes) - 1)]


def _opening(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = h[at]
    for j in range(1, k):
        out = out * BASE + h[at + j]
    return mix(out)


class SuffixArray:
    """Word suffixes of a shard that start like some test suffix, in sorted order to a depth of window words."""

    def __init__(self, words: Words, test: TestSuffixes):
        h = words.hashes
        end = np.repeat(words.first[1:], words.count)  # of each word's text
        some = np.zeros(len(h), bool)
        for k, known in test.openings.items():
            at = np.flatnonzero(np.arange(len(h)) + k <= end)
            mine = _opening(h, at, k)
            found = np.searchsorted(known, mine)
            found[found == len(known)] = 0
            some[at[known[found] == mine]] = True
        at = np.flatnonzero(some)
        span = at[:, None] + np.arange(test.window)
        rows = np.where(span < end[at][:, None], h[np.minimum(span, max(len(h) - 1, 0))], np.uint64(0))
        order = np.lexsort(rows.T[::-1]) if len(at) else np.zeros(0, np.int64)
        self.at, self.rows = at[order], rows[order]

    def bounds(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """By binary search, of each test suffix: the first row that doesn't come before it, the first that comes after it."""
        out = []
        for after in (False, True):
            lo, hi = np.zeros(len(test.start), np.int64), np.full(len(test.start), len(self.at))
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                right, same = np.full(len(open_), after), np.arange(len(open_))
                for k in range(test.window):
                    same = same[test.size[open_[same]] > k]
                    mine, theirs = self.rows[mid[same], k], test.rows(open_[same], k)
                    odd = mine != theirs
                    right[same[odd]] = mine[odd] < theirs[odd]
                    same = same[~odd]
                    if not same.size:
                        break
                lo[open_] = np.where(right, mid + 1, lo[open_])
                hi[open_] = np.where(right, hi[open_], mid)
            out.append(lo)
        return out[0], out[1]


MATCH = "struct<n:long,at:long,item:string,item_at:long>"


def _longest(text: np.ndarray, a: np.ndarray, which: np.ndarray, test: TestSuffixes) -> dict[int, tuple[int, int, str, int]]:
    """Of each text its longest match: words, place, item, place in the item. a: places in their texts."""
    if not len(a):
        return {}
    item, offset = test.item[which], test.offset[which]
    order = np.lexsort((a, a - offset, item, text))
    text, a, item, offset, size = text[order], a[order], item[order], offset[order], test.size[which][order]
    new = np.ones(len(a), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | ((a - offset)[1:] != (a - offset)[:-1]) | (a[1:] > a[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(a)) - 1
    best: dict[int, tuple[int, int, str, int]] = {}
    for t, n, p, i, o in zip(text[at].tolist(), (a[last] - a[at] + size[last]).tolist(), a[at].tolist(), item[at].tolist(), offset[at].tolist()):
        best[t] = _better(best.get(t), (n, p, test.names[i], o))
    return best


def _better(x, y):
    """The longer of two matches (n, at, item, item_at), either may be None."""
    if x is None or y is None:
        return x or y
    return min(x, y, key=lambda m: (-m[0], m[2], m[1], m[3]))


def _search(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Adds to each row its hit spans (word places start, end; as bytes), the items found and the longest match."""
    test = shared.value
    for part in slices(batches):
        words = Words(*buffers(column(part, "text")))
        spans = column(part, "spans").to_pylist()
        items = column(part, "items").to_pylist()
        match = column(part, "match").to_pylist()
        if len(test.start) and len(words.hashes):
            array = SuffixArray(words, test)
            lo, hi = array.bounds(test) if len(array.at) else (np.zeros(1, np.int64), np.zeros(1, np.int64))
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            at = array.at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(which))]
            text = np.searchsorted(words.first, at, "right") - 1
            order = np.argsort(text, kind="stable")
            text, at, which = text[order], at[order], which[order]
            at = at - words.first[text]
            cut = np.flatnonzero(np.diff(text)) + 1
            for t, a, w in zip(text[np.append(0, cut)].tolist() if len(text) else (), np.split(at, cut), np.split(which, cut)):
                spans[t] += np.stack([a, a + test.size[w]], axis=1).astype(np.int64).tobytes()
                items[t] = sorted({*items[t], *(test.names[i] for i in np.unique(test.item[w]).tolist())})
            for t, m in _longest(text, at, which, test).items():
                match[t] = dict(zip(("n", "at", "item", "item_at"), _better(tuple(match[t].values()) if match[t] else None, m)))
        new = {"spans": pa.array(spans, pa.binary()), "items": pa.array(items, pa.list_(pa.string())), "match": pa.array(match, part.schema.field("match").type)}
        yield pa.RecordBatch.from_arrays([new.get(x, column(part, x)) for x in part.schema.names], part.schema.names)


JUDGED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long, longest_item string, longest_item_at long"


def _judge(batches: Iterator[pa.RecordBatch], rest: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        n_words = Words(*buffers(column(part, "text"))).count.tolist()
        hits = []
        for x in column(part, "spans").to_pylist():
            a = np.frombuffer(x, np.int64).reshape(-1, 2)
            a = a[np.lexsort(a.T[::-1])] if len(a) else a
            reach = np.maximum.accumulate(a[:, 1]) if len(a) else a[:, 1]
            new = np.append(True, a[1:, 0] > reach[:-1])[: len(a)]
            left, right = a[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(a))[: new.sum()] - 1]
            hits.append(int((right - left).sum()))
        best = column(part, "match").flatten()
        items = column(part, "items").to_pylist()
        long = lambda x: pa.array(x, pa.int64())
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        bad = [h > 0 and 20 * h >= n for h, n in zip(hits, n_words)]
        yield pa.RecordBatch.from_arrays(
            [*(column(part, x) for x in rest), long(n_words), long(hits), long([len(x) for x in items]), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()), best[0].fill_null(0), *best[1:]],
            [*rest, *(x.split()[0] for x in JUDGED.split(", "))],
        )


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with spans (binary, int64 pairs of word places) and items (array<string>) of all occurrences of benchmark windows, and match, the longest."""
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (BLOCK_WORDS * 6)))
    out = docs.withColumns({"spans": F.lit(b""), "items": F.expr("cast(array() as array<string>)"), "match": F.expr(f"cast(null as {MATCH})")})
    schema = out.schema
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow()  # a block
        ids, text = (rows[c].combine_chunks() for c in ("id", "text"))
        test = context.broadcast(TestSuffixes(ids.to_pylist(), text, window))
        out = out.mapInArrow(partial(_search, shared=test), schema)
    return out


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; longest, longest_at, longest_item, longest_item_at: the longest verbatim match in words, where it begins in the document, its item and where it begins there."""
    found = search(docs.select("doc_id", "text"), benchmark, window)
    return found.mapInArrow(partial(_judge, rest=("doc_id",)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {JUDGED}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_hit: int = 0) -> DataFrame:
    """The rows of docs with at most so many hit words, with all their columns, whatever their names: without a threshold, those without any benchmark window."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*inner).withColumn("text", F.col(inner[docs.columns.index("text")]))
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, docs.schema))
    found = search(plain, benchmark, window).mapInArrow(partial(_judge, rest=tuple(inner)), f"{schema}, {JUDGED}")
    return found.where(F.col("n_hit") <= most_hit).select(*inner).toDF(*docs.columns)
