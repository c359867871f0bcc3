"""Token-id output: a content-addressed store of id streams.

A rolling hash over the ids cuts each document's stream (with the end id) into
chunks, so that equal passages give equal chunks. The store has

* ``chunks``: each distinct chunk once, under the digest of its ids;
* ``recipes``: each distinct stream once, under the Merkle root of its chunks:
  their digests and lengths in order;
* ``documents``: in ascending doc_id order, a document's root, its number of
  ids and its start within its part;
* ``parts``: of each part of ``documents`` the number of rows and ids, and the
  Merkle root over its documents' roots; ``manifest()`` joins them into one.

All of it is Parquet, written with Spark into the shared folder. Reading back
re-hashes every chunk and every recipe, and fails if one doesn't have the digest
under which it is stored, if one is missing, or if the index isn't what the
manifest was made of.

A worker sends each chunk and recipe it has seen to the shuffle only once
(``MOST_SEEN`` at a time), so a passage that a third of all documents share
arrives once per task. Null texts read as empty: the end id alone. Null ids come
first in the order; equal ids are told apart by their root; repeated rows are
stored as so many documents with one recipe. An empty table gives an empty
store. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .encoder import encoder
from .textkit import column, mix, slices

END_ID = 2
#: Ids that the rolling hash looks at, ids of a chunk on average and at most.
LOOK, MEAN, MOST = 16, 256, 4096
MOST_SEEN = 500_000


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves in order; an odd one moves up alone. The root over none is the digest of nothing."""
    level = [digest(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else digest(b"")


class Merkle:
    """The same root for leaves that come one by one, in memory that grows with their logarithm."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level, h = 0, digest(b"\0" + leaf)
        while self.stack and self.stack[-1][0] == level:
            h = digest(b"\1" + self.stack.pop()[1] + h)
            level += 1
        self.stack.append((level, h))

    def root(self) -> bytes:
        if not self.stack:
            return digest(b"")
        h = self.stack[-1][1]
        for _, left in reversed(self.stack[:-1]):
            h = digest(b"\1" + left + h)
        return h


def cut(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the chunks of the streams that begin at bounds (n + 1); every stream's end is one."""
    n = len(ids)
    ends = np.zeros(n + 1, bool)
    if n >= LOOK:
        h = mix(ids.astype(np.uint64) + np.uint64(1))
        roll = h[: n - LOOK + 1].copy()
        for j in range(1, LOOK):
            roll = roll * np.uint64(0x9E3779B97F4A7C55) + h[j : n - LOOK + 1 + j]
        at = np.flatnonzero(mix(roll) & np.uint64(MEAN - 1) == 0) + LOOK
        begin = bounds[np.searchsorted(bounds, at - 1, "right") - 1]
        ends[at[at - begin >= LOOK]] = True
    ends[bounds[1:]] = True
    ends[0] = False
    out = np.flatnonzero(ends)
    start = np.append(0, out[:-1])
    if (long := np.flatnonzero(out - start > MOST)).size:
        more = [np.arange(start[i] + MOST, out[i], MOST) for i in long.tolist()]
        out = np.unique(np.concatenate([out, *more]))
    return out


def packed(ids: np.ndarray) -> bytes:
    """Ids as little-endian 16-bit integers if all fit, else 32-bit, after a byte that tells the width."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\4" + ids.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


ROWS = "kind string, key binary, payload binary, doc_id long, n long"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows of chunks and recipes that this task hasn't sent yet, and of all documents."""
    seen: set[bytes] = set()
    coder = encoder(path)
    for part in slices(batches):
        ids, bounds = coder.encode(column(part, "text"), end_id)
        ids = ids.astype("<u4")
        ends = cut(ids, bounds)
        starts = np.append(0, ends[:-1])
        raw, small = ids.tobytes(), ids.max(initial=0) < 65536
        half = ids.astype("<u2").tobytes() if small else b""
        kind, key, payload, doc, n = [], [], [], [], []
        digests = [digest(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
        for h, a, b in zip(digests, starts.tolist(), ends.tolist()):
            if h not in seen:
                seen.add(h)
                kind.append("chunk")
                key.append(h)
                payload.append(b"\2" + half[2 * a : 2 * b] if small else packed(ids[a:b]))
                doc.append(None)
                n.append(b - a)
        first = np.searchsorted(ends, bounds, "right")
        sizes = (ends - starts).tolist()
        for i, d in enumerate(column(part, "doc_id").to_pylist()):
            a, b = int(first[i]), int(first[i + 1])
            root, total = merkle(digests[a:b]), int(bounds[i + 1] - bounds[i])
            if root not in seen:
                seen.add(root)
                kind.append("recipe")
                key.append(root)
                payload.append(b"".join(h + s.to_bytes(4, "little") for h, s in zip(digests[a:b], sizes[a:b])))
                doc.append(None)
                n.append(total)
            kind.append("document")
            key.append(root)
            payload.append(None)
            doc.append(d)
            n.append(total)
        if len(seen) > MOST_SEEN:
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.binary()), pa.array(payload, pa.binary()), pa.array(doc, pa.int64()), pa.array(n, pa.int64())], ["kind", "key", "payload", "doc_id", "n"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of kind and key, the first of each chunk and recipe, and all documents."""
    last = None
    for batch in batches:
        keep = []
        for k, h in zip(column(batch, "kind").to_pylist(), column(batch, "key").to_pylist()):
            keep.append(k == "document" or (k, h) != last)
            last = (k, h)
        yield batch.filter(pa.array(keep))


def _leaf(*fields: int | bytes | None) -> bytes:
    """The digest of an index row's fields."""
    return digest(b"".join(b"-" if x is None else b"+" + (x if isinstance(x, bytes) else x.to_bytes(8, "little", signed=True)) for x in fields))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one part in order, with their start in it, and a last row for the part."""
    part, at, rows, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
    names = ["kind", "part", "doc_id", "root", "start", "n"]

    def batch(kind, doc, root, start, n):
        k = len(n)
        return pa.RecordBatch.from_arrays([pa.array([kind] * k), pa.array([part] * k, pa.int32()), pa.array(doc, pa.int64()), pa.array(root, pa.binary()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names)

    for b in batches:
        n = np.array(column(b, "n").to_pylist(), np.int64)
        root = column(b, "key").to_pylist()
        start = at + np.cumsum(n) - n
        for row in zip(column(b, "doc_id").to_pylist(), root, start.tolist(), n.tolist()):
            tree.add(_leaf(*row))
        yield batch("document", column(b, "doc_id"), root, start, n)
        at, rows = at + int(n.sum()), rows + len(n)
    if rows:
        yield batch("part", [None], [tree.root()], [rows], [at])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their start in the whole store. Before those of a part stands its own row, with the ids before it; they must add up to it."""
    part, want, tree, rows, at, before = None, None, Merkle(), 0, 0, 0

    def settle():
        if want is not None and (rows, at, tree.root() if rows else b"") != want:
            raise ValueError(f"the index of part {part} is damaged")

    for b in batches:
        kept, places = [], []
        for i, (p, doc, root, start, n, ahead) in enumerate(zip(*(column(b, c).to_pylist() for c in ("part", "doc_id", "root", "start", "n", "before")))):
            if ahead is not None:
                settle()
                part, want, tree, rows, at, before = p, (start, n, root), Merkle(), 0, 0, ahead
                continue
            if p != part or start != at:
                raise ValueError(f"the index of part {p} is damaged")
            tree.add(_leaf(doc, root, start, n))
            rows, at = rows + 1, at + n
            kept.append(i)
            places.append(before + start)
        out = b.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([column(out, "doc_id"), column(out, "root"), pa.array(places, pa.int64()), column(out, "n")], ["doc_id", "root", "start", "n_tokens"])
    settle()


class Store:
    """A store in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> "Store":
        """Encodes docs (doc_id, text) and writes the store."""
        spark = docs.sparkSession
        n = scratch.partitions(spark)
        rows = docs.select("doc_id", "text").mapInArrow(partial(_encoded, path=tokenizer, end_id=end_id), ROWS)
        # Documents spread by their id, so that many of one root don't meet in one task.
        spread = F.when(F.col("kind") == "document", F.xxhash64("doc_id", "key")).otherwise(F.xxhash64("key"))
        rows.repartition(n, spread).sortWithinPartitions("kind", "key").mapInArrow(_once, ROWS).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/content")
        store = cls(spark, path)
        if store._has("document"):
            index = store._content("document").select("doc_id", "key", "n")
            index = index.repartitionByRange(n, F.asc_nulls_first("doc_id"), "key").sortWithinPartitions(F.asc_nulls_first("doc_id"), "key")
            index.mapInArrow(_numbered, "kind string, part int, doc_id long, root binary, start long, n long").write.partitionBy("kind").parquet(f"{path}/index")
        spark.createDataFrame([(store._root(store._parts()),)], "root binary").coalesce(1).write.parquet(f"{path}/manifest")
        return store

    def _has(self, kind: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/content/kind={kind}")
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def _content(self, kind: str) -> DataFrame:
        schema = "key binary, payload binary, doc_id long, n long"
        if not self._has(kind):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/content/kind={kind}")

    def _index(self, kind: str) -> DataFrame:
        schema = "part int, doc_id long, root binary, start long, n long"
        if not self._has("document"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/index/kind={kind}")

    def chunks(self) -> DataFrame:
        return self._content("chunk").select(F.col("key").alias("digest"), "payload")

    def recipes(self) -> DataFrame:
        return self._content("recipe").select(F.col("key").alias("root"), "payload", "n")

    def parts(self) -> DataFrame:
        """A row for each part, in ascending order of doc_id: part, n_docs, n_tokens, root."""
        return self._index("part").select("part", F.col("start").alias("n_docs"), F.col("n").alias("n_tokens"), "root")

    def _parts(self) -> list:
        return self.parts().orderBy("part").collect()  # one row for each written part

    @staticmethod
    def _root(parts: list) -> bytes:
        return merkle([_leaf(r["part"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in parts])

    def manifest(self) -> bytes:
        """The Merkle root over the parts: their counts, and their roots over the index rows. As it was stored at the end of the write."""
        return bytes(self.spark.read.schema("root binary").parquet(f"{self.path}/manifest").first()["root"])

    def documents(self) -> DataFrame:
        """doc_id, root, start (ids of all documents before it), n_tokens. Fails if the index isn't what the manifest was made of."""
        parts = self._parts()
        if self._root(parts) != self.manifest():
            raise ValueError("the manifest doesn't match the parts")
        total, heads = 0, []
        for r in parts:
            heads.append((r["part"], None, bytes(r["root"]), r["n_docs"], r["n_tokens"], total))
            total += r["n_tokens"]
        names = "part int, doc_id long, root binary, start long, n long, before long"
        rows = self._index("document").select("part", "doc_id", "root", "start", "n", F.lit(None).cast("long").alias("before")).union(self.spark.createDataFrame(heads, names))
        rows = rows.repartition("part").sortWithinPartitions("part", F.asc_nulls_last("before"), "start")
        return rows.mapInArrow(_placed, "doc_id long, root binary, start long, n_tokens long")

    def _pieces(self) -> DataFrame:
        """Rows (root, digest, seq, n, after) of all recipes: after, the ids that follow the chunk."""
        return self.recipes().mapInArrow(_exploded, "root binary, digest binary, seq int, n long, after long")

    def checksums(self) -> DataFrame:
        """Per root: crc32 of the whole stream's ids as little-endian 32-bit integers, from the chunks' own, and the number of ids."""
        sums = self.chunks().mapInArrow(_summed, "digest binary, crc long, n_ids long")
        found = self._pieces().join(sums, "digest", "left")
        shifted = found.mapInArrow(_shifted, "root binary, crc long, n long")
        return shifted.groupBy("root").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n_ids"))

    def summary(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, root of all documents, from the stored chunks. Fails if a document's recipe is missing or has another number of ids."""
        found = self.documents().join(self.checksums(), "root", "left")
        return found.mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long, root binary")

    def read(self, roots: DataFrame | None = None) -> DataFrame:
        """Rebuilds streams: (root, ids array<int>). roots: a DataFrame with the roots to rebuild."""
        pieces = self._pieces()
        if roots is not None:
            pieces = pieces.join(roots.select("root").distinct(), "root", "left_semi")
        whole = pieces.join(self.chunks(), "digest").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("p"))
        return whole.select("root", F.col("p.payload").alias("p")).mapInArrow(_joined, "root binary, ids array<int>")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "payload"):
        root, dig, seq, n, after = [], [], [], [], []
        for r, p, total in zip(column(batch, "root").to_pylist(), column(batch, "payload").to_pylist(), column(batch, "n").to_pylist()):
            d = [p[i : i + 16] for i in range(0, len(p), 20)]
            if merkle(d) != r:
                raise ValueError(f"the recipe {r.hex()} is damaged")
            size = np.frombuffer(p, "<u4").reshape(-1, 5)[:, 4].astype(np.int64)
            if size.sum() != total:
                raise ValueError(f"the recipe {r.hex()} has another length")
            root += [r] * len(d)
            dig += d
            seq.append(np.arange(len(d), dtype=np.int32))
            n.append(size)
            after.append(total - np.cumsum(size))
        yield pa.RecordBatch.from_arrays([pa.array(root, pa.binary()), pa.array(dig, pa.binary()), pa.array(np.concatenate(seq)), pa.array(np.concatenate(n)), pa.array(np.concatenate(after))], ["root", "digest", "seq", "n", "after"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "payload"):
        keys, crc, n = column(batch, "digest"), [], []
        for k, p in zip(keys.to_pylist(), column(batch, "payload").to_pylist()):
            ids = unpacked(p)
            raw = ids.tobytes()
            if digest(raw) != k:
                raise ValueError(f"the chunk {k.hex()} is damaged")
            crc.append(zlib.crc32(raw))
            n.append(len(ids))
        yield pa.RecordBatch.from_arrays([keys, pa.array(crc, pa.int64()), pa.array(n, pa.int64())], ["digest", "crc", "n_ids"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if column(b, "ids_crc32").null_count:
            raise ValueError("a document's recipe isn't in the store")
        if column(b, "n_tokens") != column(b, "n_ids"):
            raise ValueError("a document has another number of ids than its recipe")
        yield b.select(["doc_id", "start", "n_tokens", "ids_crc32", "root"])


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the one of crc32, bits reflected."""
    out, b = np.zeros(np.broadcast(a, b).shape, np.uint32), np.broadcast_to(b, np.broadcast(a, b).shape).copy()
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _POLY, b >> np.uint32(1))
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part's crc32 adds to the whole's if so many bytes follow it."""
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    step = np.array([1 << 23], np.uint32)  # x to the power of 8
    while n.any():
        odd = np.flatnonzero(n & 1)
        if odd.size:
            out[odd] = _times(out[odd], step)
        step, n = _times(step, step), n >> 1
    return out


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        if column(b, "crc").null_count:
            raise ValueError("a recipe names a chunk that isn't in the store")
        n, have = (np.array(column(b, x).to_numpy(zero_copy_only=False)) for x in ("n", "n_ids"))
        if (n != have).any():
            raise ValueError("a chunk has another length than its recipe says")
        crc = shift_crc(column(b, "crc").to_numpy(zero_copy_only=False).astype(np.uint32), 4 * column(b, "after").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([column(b, "root"), pa.array(crc.astype(np.int64)), pa.array(n)], ["root", "crc", "n"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [np.concatenate([unpacked(p) for p in x]).astype(np.int32) for x in column(b, "p").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(b, "root"), pa.array(ids, pa.list_(pa.int32()))], ["root", "ids"])
