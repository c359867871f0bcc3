"""Document fingerprints by improbable features.

Every window of ``WIDTH`` bytes has an entropy. Entropies that few windows of the
whole corpus have are improbable, and windows are ranked by that; those of very
low entropy say nothing and are left out. In every ``NEAR`` windows in a row, the
most improbable, the leftmost of equals, gets a point; windows with ``POINTS`` or
more are a text's features. They go into Bloom filters of ``BITS`` bits, five
bits each, a new filter after every ``ROOM`` features. A text of fewer than
``WIDTH`` bytes, but not none, is filled up with zero bytes to one window.

Likeness of two fingerprints: each filter of the one with fewer is compared with
the other's, by the bits in common between what chance gives (0) and the most
possible (1); the best counts, and the mean over the filters is the result. Equal
fingerprints have 1; an empty text's fingerprint is empty and like no other.

The fingerprint depends on the text and on the corpus' ranks alone. Null texts
read as empty. For the order of documents, equal ids are ordered by a hash of
their text, null ids come last; with one document it is its own next. Repeated
rows have a result each. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkit import Prefix, buffers, column, mix, slices, sliding_min

WIDTH, NEAR, POINTS = 32, 32, 8
BITS, ROOM, HASHES = 2048, 160, 5
STEPS = 1000
#: Entropies below this share of the most possible make no features.
WEAK = 0.15
#: Bytes of text in a range of documents, about.
RANGE_BYTES = 64 << 20

_SCALE = 1 << 16
_N_LOG_N = np.array([round(c * np.log2(c) * _SCALE) if c else 0 for c in range(WIDTH + 2)], np.int64)
_MOST = int(_N_LOG_N[WIDTH])
_UP = (_N_LOG_N[1:] - _N_LOG_N[:-1]).astype(np.int32)  # by one more of n


def entropies(data: np.ndarray) -> np.ndarray:
    """Of every window of WIDTH bytes, its entropy in STEPS steps."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WIDTH):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    # From one window to the next: the byte that leaves stood there 1 + ahead times, the one that comes joins those behind it.
    change = _UP[behind[WIDTH:]] - _UP[ahead[: n - 1]]
    first = np.bincount(data[:WIDTH], minlength=256)
    total = np.empty(n, np.int64)
    total[0] = _N_LOG_N[first].sum()
    total[1:] = change
    np.cumsum(total, out=total)
    return ((_MOST - total) * STEPS // _MOST).astype(np.uint16)


def _inside(off: np.ndarray, n: int, width: int, texts: np.ndarray) -> np.ndarray:
    """Which windows of these texts are inside of them."""
    ok = np.zeros(n + width, bool)
    for a, b in zip(off[:-1][texts].tolist(), (off[1:][texts] - width + 1).tolist()):
        if b > a:
            ok[a:b] = True
    return ok[:n]


def ranks(histogram: np.ndarray) -> np.ndarray:
    """Of each entropy step its rank by improbability from 0; steps that make no features have the last."""
    order = np.lexsort((np.arange(STEPS + 1), histogram))
    rank = np.empty(STEPS + 1, np.uint64)
    rank[order] = np.arange(STEPS + 1)
    rank[: int(WEAK * STEPS)] = 4095
    return rank


def _filled(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with zero bytes added to those that are shorter than a window, but not empty."""
    size = np.diff(off)
    wide = np.where((size > 0) & (size < WIDTH), WIDTH, size)
    if (wide == size).all():
        return data, off
    new = np.append(0, np.cumsum(wide))
    out = np.zeros(new[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(new[:-1] - off[:-1], size)] = data
    return out, new


def features(data: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features, each once, in the order in which they stand."""
    data, off = _filled(data, off)
    step = entropies(data)
    r = rank[step]
    r[~_inside(off, len(step), WIDTH, np.flatnonzero(np.diff(off)))] = 4095
    pad = NEAR - 1
    key = np.full(len(r) + 2 * pad, 4095, np.uint64)
    key[pad : pad + len(r)] = r
    low = np.uint64(40)
    key = key << low | np.arange(len(key), dtype=np.uint64)
    best = sliding_min(key, NEAR)
    best = best[best >> low < 4095]
    points = np.bincount((best & np.uint64((1 << 40) - 1)).astype(np.int64), minlength=len(key))[pad : pad + len(r)]
    at = np.flatnonzero(points >= POINTS)
    text, h = np.searchsorted(off, at, "right") - 1, Prefix(data).at(at, at + WIDTH)
    order = np.lexsort((at, h, text))
    t, s = text[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
    keep = np.sort(order[new])
    return text[keep], h[keep]


def filters(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters, a row of BITS / 8 bytes each, and the n + 1 places where each text's begin."""
    count = np.bincount(text, minlength=n)
    need = -(-count // ROOM)
    first = np.append(0, np.cumsum(need))
    begin = np.append(0, np.cumsum(count))
    row = first[text] + (np.arange(len(text)) - begin[text]) // ROOM
    bits = np.zeros((first[-1], BITS), bool)
    for k in range(HASHES):
        bits[row, (h >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(bits, axis=1), first


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two fingerprints as rows of filters, 0 to 1."""
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    if not len(a):
        return 1.0 if not len(b) else 0.0
    if len(a) == len(b) and a.tobytes() == b.tobytes():
        return 1.0
    best = np.zeros(len(a))
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    for at in range(0, len(b), 256):
        part = b[at : at + 256]
        for i in range(len(a)):
            common = np.bitwise_count(a[i] & part).sum(axis=1, dtype=np.int64)
            best[i] = max(best[i], _normal(common, na[i], nb[at : at + 256]).max())
    return float(best.mean())


def _normal(common, na, nb):
    chance, most = na * nb / BITS, np.minimum(na, nb)
    return np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)


def likenesses(fa: np.ndarray, at_a: np.ndarray, fb: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Of each text's two fingerprints."""
    n = len(at_a) - 1
    out = np.zeros(n)
    one = np.flatnonzero((np.diff(at_a) == 1) & (np.diff(at_b) == 1))
    if one.size:
        a, b = fa[at_a[one]], fb[at_b[one]]
        na, nb, common = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b, a & b))
        out[one] = np.where((a == b).all(axis=1), 1.0, _normal(common, na, nb))
    for i in np.setdiff1d(np.arange(n), one).tolist():
        out[i] = likeness(fa[at_a[i] : at_a[i + 1]], fb[at_b[i] : at_b[i + 1]])
    return out


def fingerprint(texts: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data, off = buffers(texts)
    return filters(*features(data, off, rank), len(off) - 1)


def _text_of(rows: np.ndarray, at: np.ndarray) -> list[str]:
    return [base64.b64encode(rows[a:b].tobytes()).decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(STEPS + 1, np.int64)
    for part in slices(batches):
        data, off = buffers(column(part, "text"))
        step = entropies(data)
        total += np.bincount(step[_inside(off, len(step), WIDTH, np.arange(len(off) - 1))], minlength=STEPS + 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["step", "n"])


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy steps by how few windows of all documents have them."""
    out = np.zeros(STEPS + 1, np.int64)
    for r in docs.select("text").mapInArrow(_histogram, "step int, n long").groupBy("step").agg(F.sum("n")).collect():  # at most STEPS + 1 rows
        out[r[0]] = r[1]
    return ranks(out)


def _fingerprints(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(_text_of(*fingerprint(column(part, "text"), rank)), pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Per document: doc_id, fingerprint."""
    rank = corpus_ranks(docs) if rank is None else rank
    return docs.select("doc_id", "text").mapInArrow(partial(_fingerprints, rank=rank), "doc_id long, fingerprint string")


def _edited(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts whose last half is replaced by the beginning of the next text (the last has none), and all code point counts."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, off)
    n = np.diff(first)
    place = np.append(lead, len(data))
    half = n[:-1] // 2
    cut = np.where(half > 0, place[np.minimum(first[:-2] + n[:-1] - half, len(lead))], off[1:-1])
    take = np.minimum(half, n[1:])
    stop = np.where(take < n[1:], place[np.minimum(first[1:-1] + take, len(lead))], off[2:])
    raw = data.tobytes()
    out = [raw[a:c] + raw[b:e] for a, c, b, e in zip(off[:-2].tolist(), cut.tolist(), off[1:-1].tolist(), stop.tolist())]
    return pa.array(out, pa.binary()), n


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ENDS = "part int, side int, end_id long, end_text string"


def _pairs(texts: pa.Array, ids: pa.Array, own: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """Those documents (places in texts) against the text after each."""
    edited, n = _edited(*buffers(texts))
    f, at = fingerprint(texts, rank)
    g, at_g = fingerprint(edited, rank)
    near_edited, near_next = likenesses(f, at[:-1], g, at_g), likenesses_next(f, at)
    print_f, print_g = _text_of(f, at), _text_of(g, at_g)
    sha = [hashlib.sha256(x).hexdigest() for x in edited.to_pylist()]
    pick = lambda x: pa.array([x[i] for i in own.tolist()], pa.string())
    columns = [ids.take(pa.array(own)), pa.array(n[own].astype(np.int64)), pick(sha), pick(print_f), pick(print_g), pa.array(near_edited[own]), pa.array(near_next[own])]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in COMPARED.split(", ")])


def _compared(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a range in the order of documents, compared up to the last; then the range's first (side 0) and last document (side 1), whole."""
    names, kinds = [x.split()[0] for x in f"{COMPARED}, {_ENDS}".split(", ")], [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.int32(), pa.int64(), pa.string()]
    held, first = None, None
    for part in slices(batches):
        part = part.select(["doc_id", "text"])
        first = first or (column(part, "doc_id")[0].as_py(), column(part, "text")[0].as_py())
        joined = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
        held = joined.slice(joined.num_rows - 1)
        if (n := joined.num_rows - 1) > 0:
            out = _pairs(column(joined, "text"), column(joined, "doc_id"), np.arange(n), rank)
            yield pa.RecordBatch.from_arrays([*out.columns, *(pa.nulls(n, k) for k in kinds[len(out.columns) :])], names)
    if first:
        where = TaskContext.get().partitionId()
        ends = [(where, 0, *first), (where, 1, column(held, "doc_id")[0].as_py(), column(held, "text")[0].as_py())]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(2, k) for k in kinds[:-4]), *(pa.array([e[i] for e in ends], k) for i, k in enumerate(kinds[-4:]))], names)


def _met(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The last document of a range against the first of the next."""
    for part in batches:
        for i in range(part.num_rows):
            ids = column(part, "end_id").slice(i, 1)
            texts = pa.array([column(part, "end_text")[i].as_py(), column(part, "next_text")[i].as_py()], pa.string())
            yield _pairs(texts, pa.concat_arrays([ids, pa.nulls(1, pa.int64())]), np.array([0]), rank)


def likenesses_next(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each fingerprint but the last to the one after it."""
    n = len(at) - 2
    size = np.diff(at)
    out = np.zeros(n)
    one = np.flatnonzero((size[:-1] == 1) & (size[1:] == 1))
    if one.size:
        a, b = f[at[one]], f[at[one + 1]]
        na, nb, common = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b, a & b))
        out[one] = np.where((a == b).all(axis=1), 1.0, _normal(common, na, nb))
    for i in np.setdiff1d(np.arange(n), one).tolist():
        out[i] = likeness(f[at[i] : at[i + 1]], f[at[i + 1] : at[i + 2]])
    return out


def compare_edited(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document, in descending doc_id order.

    Documents are dealt once into ranges of doc_id, equal ids by a hash of their
    text, so that no id fills a range. Each range compares its own neighbours and
    hands on its first and last document; these meet in a join of two rows a
    range.
    """
    spark = docs.sparkSession
    rank = corpus_ranks(docs) if rank is None else rank
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long")).alias("sid"))
    parts = max(scratch.partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    order = [F.desc("sid"), F.asc("h")]
    rows = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = scratch.written(rows.mapInArrow(partial(_compared, rank=rank), f"{COMPARED}, {_ENDS}"), "ranges", "zstd")
    names = [x.split()[0] for x in COMPARED.split(", ")]
    ends = rows.where("part is not null").select(*(x.split()[0] for x in _ENDS.split(", ")))
    used = sorted(r["part"] for r in ends.where("side = 0").select("part").collect())  # a number for each range
    after = spark.createDataFrame(list(zip(used, [*used[1:], *used[:1]])), "part int, next int")
    first = ends.where("side = 0").select(F.col("part").alias("next"), F.col("end_text").alias("next_text"))
    met = ends.where("side = 1").join(after, "part").join(first, "next").select("end_id", "end_text", "next_text").mapInArrow(partial(_met, rank=rank), COMPARED)
    return rows.where("part is null").select(*names).union(met)
