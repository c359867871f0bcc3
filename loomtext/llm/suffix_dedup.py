"""Exact repeated-passage removal with two-stage suffix sorting.

Removes every byte that is covered by a string of ``length`` bytes that starts
at two places or more, in one document or in several; matches never cross
documents, and strings are judged on the input.

How it is spread over executors, without losing a match:

1. *Anchors.* Every window of ``length`` bytes is dealt to the place of its
   smallest ``GRAM``-byte hash. Equal windows have equal anchors, and a stretch
   of windows that share one needs one row. A row holds the anchor's hash and a
   digest of all bytes that its windows cover (its context).
2. *Settled contexts.* Contexts that occur twice are repeated throughout; those
   whose anchor occurs in no other context are not repeated at all. Both need
   counts only. A task settles what occurs twice in its own slice of text on the
   spot, as whole stretches, and sends each such context on once, with its
   count: a passage that a third of all documents hold is a row for each slice,
   not for each document, and so is a long run of one byte.
3. *Suffix sorting.* The rest (edges of passages, edited copies), one context of
   each kind, is gathered by anchor and suffix-sorted: suffixes smaller than
   their successors are sorted directly, the others are induced by bucket scans
   in order of the first byte, and common prefixes of neighbours tell which
   windows repeat. Anchors with more than ``MOST_CONTEXTS`` contexts are settled
   by counting digests of each single window instead, which spreads over all
   tasks.

Null texts read as empty; empty texts keep nothing and lose nothing; texts under
``length`` bytes are kept whole; repeated rows, equal ids and null ids are
separate documents. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkit import Prefix, Words, buffers, column, slices, sliding_argmin

LENGTH = 400
GRAM = 100
#: A passage of over 50 words, in words and in bytes that it has at least.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 200
MOST_CONTEXTS = 4096
#: Bytes of contexts that are suffix-sorted at once.
SORT_BYTES = 1 << 18


# Two-stage suffix sorting

def suffix_types(codes: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor. codes end with a 0, which is smaller than all."""
    step = np.sign(np.diff(codes.astype(np.int32)))
    known = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    known = np.minimum.accumulate(known[::-1])[::-1]
    return np.append(step[known] > 0, False)


def two_stage_sort(data: bytes, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places of data in the order of their suffixes, which end at the next of ends.

    Suffixes are told apart up to depth bytes at least. Stage one sorts those
    that are smaller than their successors; stage two scans the buckets from the
    smallest first byte on and puts the predecessor of each suffix, if it is
    larger than it, at the next free place of its own bucket.
    """
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    codes = np.zeros(n + len(ends), np.uint16)  # each stretch ends with a 0
    shift = np.searchsorted(ends, np.arange(n), "right")
    codes[np.arange(n) + shift] = text.astype(np.uint16) + 1
    rising = suffix_types(codes)[np.arange(n) + shift]
    first = text.astype(np.int64) + 1
    # The successors that the wanted ones are induced from, up to the next rising suffix or the stretch's end.
    need = np.zeros(n + 1, bool)
    need[wanted] = True
    last = np.zeros(n, bool)
    last[ends[ends > 0] - 1] = True
    grow = np.flatnonzero(need[:n] & ~rising & ~last)
    while grow.size:
        grow = np.unique(grow + 1)
        grow = grow[~need[grow]]
        need[grow] = True
        grow = grow[~rising[grow] & ~last[grow]]
    need = need[:n]
    stop = ends[shift]
    direct = np.flatnonzero(need & rising)
    keys = [data[i : min(i + depth, e)] for i, e in zip(direct.tolist(), stop[direct].tolist())]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)] if keys else direct
    by_first = np.argsort(first[direct], kind="stable")
    direct, bounds = direct[by_first], np.searchsorted(first[direct][by_first], np.arange(258))
    pending: dict[int, list[np.ndarray]] = {}
    ended = np.flatnonzero(need & last & ~rising)  # their successor is the stretch's end: smallest of their bucket
    for c in np.unique(first[ended]).tolist():
        pending[c] = [ended[first[ended] == c]]
    out = []

    def before(done: np.ndarray) -> np.ndarray:
        prev = done[done > 0] - 1
        return prev[need[prev] & ~rising[prev] & ~last[prev]]

    for c in np.unique(first[need]).tolist():
        layer = np.concatenate(pending.pop(c)) if c in pending else np.zeros(0, np.int64)
        bucket = []
        while layer.size:
            bucket.append(layer)
            layer = before(layer)
            layer = layer[first[layer] == c]
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(bucket)
        out.append(bucket)
        prev = before(bucket)
        prev = prev[first[prev] > c]
        for d in np.unique(first[prev]).tolist():
            pending.setdefault(d, []).append(prev[first[prev] == d])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    mark = np.zeros(n, bool)
    mark[wanted] = True
    return order[mark[order]]


def neighbour_lcp(data: bytes, ends: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix of order has in common with the one before it, up to depth; the first has 0."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    text = np.frombuffer(data + bytes(depth + 8), np.uint8)
    word = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        word |= text[k : len(text) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    a, b = order[:-1], order[1:]
    room = np.minimum(ends[np.searchsorted(ends, a, "right")] - a, ends[np.searchsorted(ends, b, "right")] - b)
    room = np.minimum(room, depth)
    alive = np.arange(len(a))
    found = room.copy()
    for k in range(0, depth, 8):
        diff = word[a[alive] + k] ^ word[b[alive] + k]
        if (off := np.flatnonzero(diff)).size:
            low = diff[off] & (~diff[off] + np.uint64(1))
            found[alive[off]] = np.minimum(room[alive[off]], k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3))
        alive = alive[(diff == 0) & (room[alive] > k + 8)]
        if not alive.size:
            break
    out[1:] = found
    return out


def repeated_places(data: bytes, ends: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Those wanted places whose next length bytes also stand at another wanted place."""
    order = two_stage_sort(data, ends, wanted, length)
    same = neighbour_lcp(data, ends, order, length) >= length
    same[:-1] |= same[1:].copy()
    return np.sort(order[same])


# Anchors

ANCHORS = "g long, c long, id long, t int, lo int, hi int, n long"


def _twice(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of keys: how many rows are equal to it, and whether it is the first of them."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(order)))
    count, first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    count[order], first[order[at]] = np.repeat(many, many), True  # the sort is stable
    return count, first


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row for each context, with how often this slice has it: only its first place, if twice or more; and rows without g, stretches that repeat for sure."""
    for part in slices(batches):
        data, off = buffers(column(part, "text"))
        if len(data) < length:
            continue
        hashes = Prefix(data).every(gram)
        place = sliding_argmin(hashes, length - gram + 1)
        starts = np.arange(len(place))
        text = np.searchsorted(off, starts, "right") - 1
        ok = starts + length <= off[text + 1]
        starts, place, text = starts[ok], place[ok], text[ok]
        if not starts.size:
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        lo, hi = starts[at], starts[np.append(at[1:], len(starts)) - 1]
        anchor, text = place[at], text[at]
        raw = data.tobytes()
        digest = hashlib.blake2b
        c = b"".join(
            digest(raw[a : b + length], digest_size=8, salt=k.to_bytes(4, "little")).digest()
            for a, b, k in zip(lo.tolist(), hi.tolist(), (anchor - lo).tolist())
        )
        g, c = hashes[anchor].view(np.int64), np.frombuffer(c, np.int64)
        n, first = _twice(c, g)
        sure = np.flatnonzero(n > 1)
        # Neighbours of one text that are sure make one stretch.
        apart = np.ones(len(sure), bool)
        apart[1:] = (text[sure][1:] != text[sure][:-1]) | (lo[sure][1:] != hi[sure][:-1] + 1)
        begin = sure[apart]
        end = sure[np.append(np.flatnonzero(apart)[1:], len(sure)) - 1] if len(sure) else sure
        row = np.concatenate([np.flatnonzero(first), begin])
        none = np.arange(len(row)) >= len(row) - len(begin)
        last = np.concatenate([np.flatnonzero(first), end])
        who, base = pa.array(text[row]), off[text[row]]
        columns = [
            pa.array(g[row], mask=none), pa.array(c[row], mask=none), column(part, "id").take(who), column(part, "t").take(who),
            pa.array((lo[row] - base).astype(np.int32)), pa.array((hi[last] - base).astype(np.int32)), pa.array(n[row]),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["g", "c", "id", "t", "lo", "hi", "n"])


# Marks: which documents share passages of so many words

MARKS = "g long, id long, t int, n long"


def _marks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Marks of texts, each once a text: as for contexts, one row for those that several texts of this slice have, and rows without g with how many such marks a text has."""
    k = words // 2 + 1
    for part in slices(batches):
        h, text = Words(*buffers(column(part, "text"))).grams(k, short=False)
        w = words - k + 1
        if len(h) < w:
            continue
        place = sliding_argmin(h, w)
        place = np.unique(place[text[: len(place)] == text[w - 1 :]])
        h, text = h[place], text[place]
        _, new = _twice(text, h)
        h, text = h[new], text[new]
        n, first = _twice(h)
        sure = np.bincount(text[n > 1], minlength=part.num_rows)
        some = np.flatnonzero(sure)
        who = pa.array(np.concatenate([text[first], some]))
        none = np.arange(len(who)) >= len(who) - len(some)
        g = np.concatenate([h[first].view(np.int64), np.zeros(len(some), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(g, mask=none), column(part, "id").take(who), column(part, "t").take(who), pa.array(np.concatenate([n[first], sure[some]]))], ["g", "id", "t", "n"])


def shared_marks(docs: DataFrame, words: int) -> DataFrame:
    """docs (id, t, text): id, t, n_shared of the texts with marks that other documents have too."""
    marks = scratch.written(docs.select("id", "t", "text").mapInArrow(partial(_marks, words=words), MARKS), "marks")
    shared = marks.where("g is not null").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g")
    found = marks.where("n = 1 and g is not null").join(shared, "g", "left_semi")
    return found.union(marks.where("g is null")).groupBy("id", "t").agg(F.sum("n").alias("n_shared"))


CONTEXTS = "g long, id long, t int, lo int, hi int, alone boolean, many boolean, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["g", "id", "t", "lo", "hi", "alone", "many"]
    for part in slices(batches):
        data, off = buffers(column(part, "text"))
        raw = data.tobytes()
        at = off[:-1].tolist()
        cut = [raw[o + a : o + b + length] for o, a, b in zip(at, column(part, "lo").to_pylist(), column(part, "hi").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(column(part, x) for x in names), pa.array(cut, pa.binary())], [*names, "bytes"])


RUNS = "id long, t int, lo int, hi int"


def _runs(ids, ts, los) -> pa.RecordBatch:
    """Rows of runs of window starts; equal neighbours of one document are joined."""
    ids, ts, los = (np.concatenate(x) for x in (ids, ts, los))
    new = np.ones(len(los), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (ts[1:] != ts[:-1]) | (los[1:] != los[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(los)) - 1
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ts[at]), pa.array(los[at].astype(np.int32)), pa.array(los[end].astype(np.int32))], ["id", "t", "lo", "hi"])


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Suffix-sorts contexts, which come in order of g; a group of one g is never cut in two."""
    held: list[tuple] = []
    size = 0

    def settle():
        data = b"".join(r[6] for r in held)
        ends = np.cumsum([len(r[6]) for r in held])
        base = np.concatenate([[0], ends[:-1]])
        wide = np.array([r[4] - r[3] + 1 for r in held])
        owner = np.repeat(np.arange(len(held)), wide)
        wanted = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(wide) - wide, wide)
        hit = repeated_places(data, ends, wanted, length)
        who = np.searchsorted(ends, hit, "right")
        keep = np.array([r[5] for r in held])[who]
        hit, who = hit[keep], who[keep]
        if hit.size:
            lo = np.array([r[3] for r in held])
            return _runs([np.array([r[1] for r in held], np.int64)[who]], [np.array([r[2] for r in held], np.int32)[who]], [lo[who] + hit - base[who]])

    for batch in batches:
        cols = [column(batch, x).to_pylist() for x in ("g", "id", "t", "lo", "hi", "alone", "bytes")]
        for row in zip(*cols):
            if size >= SORT_BYTES and row[0] != held[-1][0]:
                if (out := settle()) is not None:
                    yield out
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held and (out := settle()) is not None:
        yield out


WINDOWS = "w1 long, w2 long, id long, t int, lo int, alone boolean"


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "bytes", 64 << 10):
        wide, d = [], []
        for raw, a, b in zip(column(part, "bytes").to_pylist(), column(part, "lo").to_pylist(), column(part, "hi").to_pylist()):
            wide.append(b - a + 1)
            d += [hashlib.blake2b(raw[k : k + length], digest_size=16).digest() for k in range(b - a + 1)]
        who = np.repeat(np.arange(len(wide)), wide)
        w = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
        lo = np.array(column(part, "lo").to_pylist())[who] + np.arange(len(who)) - np.repeat(np.cumsum(wide) - wide, wide)
        take = lambda x: column(part, x).take(pa.array(who))
        yield pa.RecordBatch.from_arrays([pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), take("id"), take("t"), pa.array(lo.astype(np.int32)), take("alone")], ["w1", "w2", "id", "t", "lo", "alone"])


def merge(runs, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans (start, end) that windows starting in the runs (lo, hi) cover, joined where they overlap or touch."""
    a = np.array(sorted((r["lo"], r["hi"] + length) for r in runs), np.int64).reshape(-1, 2)
    if not len(a):
        return a[:, 0], a[:, 1]
    reach = np.maximum.accumulate(a[:, 1])
    new = np.ones(len(a), bool)
    new[1:] = a[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return a[at, 0], reach[np.append(at[1:], len(a)) - 1]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, rest: tuple[str, ...] = (), words: int = 0) -> DataFrame:
    """docs (doc_id, text, rest) with `runs`, array<struct<lo,hi>>: the runs of starts of repeated windows; null if none. words: also n_shared, see remove_repeats."""
    spark = docs.sparkSession
    # Equal ids of different texts are told apart by t; equal rows have equal results.
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *rest).select(
        "*",
        F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long")).alias("id"),
        F.expr("cast(shiftrightunsigned(xxhash64(text), 33) as int)").alias("t"),
    )
    anchors = scratch.written(
        docs.where(F.octet_length("text") >= length).select("id", "t", "text").mapInArrow(partial(_anchors, length=length, gram=gram), ANCHORS), "anchors"
    )
    classes = anchors.where("g is not null").groupBy("g", "c").agg(F.sum("n").alias("n"), F.min(F.struct("id", "t", "lo", "hi")).alias("rep"))
    classes = scratch.written(classes, "contexts")
    settled = anchors.where("n = 1").join(classes.where("n > 1").select("g", "c"), ["g", "c"], "left_semi").union(anchors.where("g is null")).select("id", "t", "lo", "hi")
    shared = classes.groupBy("g").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).where("kinds > 1 and fewest = 1")
    needed = classes.join(shared, "g").select("g", "rep.*", (F.col("n") == 1).alias("alone"), (F.col("kinds") > MOST_CONTEXTS).alias("many"))
    contexts = scratch.written(
        needed.hint("shuffle_merge").join(docs.select("id", "t", "text"), ["id", "t"]).select("g", "id", "t", "lo", "hi", "alone", "many", "text")
        .mapInArrow(partial(_contexts, length=length), CONTEXTS).dropDuplicates(["g", "id", "t", "lo"]),
        "contexts",
    )
    n = scratch.partitions(spark)
    few = contexts.where("not many").drop("many").repartition(n, "g").sortWithinPartitions("g").mapInArrow(partial(_sorted_groups, length=length), RUNS)
    windows = contexts.where("many").mapInArrow(partial(_windows, length=length), WINDOWS)
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
    many = windows.where("alone").join(twice, ["w1", "w2"], "left_semi").select("id", "t", "lo", F.col("lo").alias("hi"))
    runs = settled.union(few).union(many).groupBy("id", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    out = docs.join(runs.hint("shuffle_merge"), ["id", "t"], "left")
    if words:
        out = out.join(shared_marks(docs, words).hint("shuffle_merge"), ["id", "t"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("long")))
        rest = (*rest, "n_shared")
    return out.select("doc_id", "text", *rest, "runs")


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(batches: Iterator[pa.RecordBatch], length: int, with_bytes: bool, rest: tuple[str, ...], valid: bool = False, after: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        data, off = buffers(column(part, "text"))
        raw = data.tobytes()
        sizes, removed, spans, sha, kept = [], [], [], [], []
        for a, b, runs in zip(off[:-1].tolist(), off[1:].tolist(), column(part, "runs").to_pylist()):
            text = raw[a:b]
            left, right = merge(runs or (), length)
            keep, at = [], 0
            for x, y in zip(left.tolist(), right.tolist()):
                keep.append(text[at:x])
                at = y
            keep = b"".join([*keep, text[at:]])
            sizes.append(b - a)
            removed.append(b - a - len(keep))
            spans.append(len(left))
            sha.append(hashlib.sha256(keep).hexdigest())
            kept.append((keep.decode("utf-8", "ignore").encode() if valid else keep) if with_bytes else None)
        long = lambda x: pa.array(x, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(column(part, x) for x in rest), long(sizes), long(removed), long(spans), pa.array(sha, pa.string()), pa.array(kept, pa.binary()), *(column(part, x) for x in after)],
            [*rest, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *after],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_bytes: bool = True, words: int = PASSAGE_WORDS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null unless with_bytes), n_shared.

    n_shared tells of passages that may be shorter than length: among all runs of
    half as many words as `words` and one more, marks are chosen so that every
    run of `words` words has one, and the same in all texts. It is the number of
    a document's marks that other documents have too: above 0 if it shares a
    passage of so many words, whatever their length in bytes.
    """
    spans = repeated_spans(docs, length, length // 4, words=words)
    return spans.mapInArrow(partial(_removed, length=length, with_bytes=with_bytes, rest=("doc_id",), after=("n_shared",)), f"{REMOVED}, n_shared long")


def strip_repeats(docs: DataFrame, length: int = PASSAGE_BYTES) -> DataFrame:
    """The rows of docs with what remains of their texts, and n_chars, if there, to match.

    Of a passage that stands at several places, no place stays. A character of
    which a byte was removed goes whole. Null texts stay null; all other columns
    stay as they are. The default length is less than any 51 words of four
    letters with their blanks.
    """
    inner = tuple(f"c{i}" for i in range(len(docs.columns)))
    name = dict(zip(docs.columns, inner))
    plain = docs.toDF(*inner).withColumns({"doc_id": F.col(name["doc_id"]), "text": F.col(name["text"])})
    rest = tuple(c for c in inner if c != name["text"])
    spans = repeated_spans(plain.withColumn("gone", F.col("text").isNull()), length, length // 4, (*rest, "gone"))
    schema = "".join(f"{c} {f.dataType.simpleString()}, " for c, f in zip(inner, docs.schema) if c in rest) + "gone boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = spans.mapInArrow(partial(_removed, length=length, with_bytes=True, rest=(*rest, "gone"), valid=True), schema)
    text = F.when(~F.col("gone"), F.col("kept").cast("string"))
    new = {name["text"]: text}
    if "n_chars" in name:
        new[name["n_chars"]] = F.when(F.col("gone") | (F.col("n_removed") == 0), F.col(name["n_chars"])).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*((new[c] if c in new else F.col(c)).alias(d) for d, c in zip(docs.columns, inner)))
