"""Vectorised byte-level text kernels shared by the operators of this subpackage.

Texts reach Python as Arrow string arrays; everything here works on their
UTF-8 buffer with numpy, half a megabyte at a time, so a worker's memory does
not depend on how many rows Spark puts into a batch.

A *word* is a run of bytes matching ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after
A-Z have been lower-cased: digits, a-z and every byte of a non-ASCII character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C55)
INV_BASE = np.uint64(pow(int(BASE), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", BASE), ("down", INV_BASE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_of(word: str) -> int:
    """The hash that Words gives to this word."""
    return int(Words(*buffers(pa.array([word]))).hashes[0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets into them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most this many bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    hand_back()


def hand_back() -> None:
    """Returns to the system what a finished task has freed; a worker that waits for its next task holds no more than it needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Prefix:
    """Prefix sums that give the hash of any stretch of the bytes in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * up[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, k: int) -> np.ndarray:
        """Of every stretch of k bytes, by its start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


class Words:
    """The words of a slice of texts: byte spans, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.low, self.off = LOWER[data], off
        mask = IS_WORD[self.low]
        edge = np.zeros(len(mask) + 1, bool)
        edge[off] = True
        before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        self.start = np.flatnonzero(mask & (~before | edge[:-1]))
        self.end = np.flatnonzero(mask & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)  # of each text, n + 1
        self.count = np.diff(self.first)
        self.hashes = Prefix(self.low).at(self.start, self.end)

    def text_of(self) -> np.ndarray:
        """Which text each word is in."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words in a text, and the text each is in. short: a text of fewer words, but not none, is one run."""
        h, n = self.hashes, len(self.hashes)
        text = self.text_of()
        if n < k:
            out, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        else:
            out = h[: n - k + 1].copy()
            for j in range(1, k):
                out *= BASE
                out += h[j : n - k + 1 + j]
            inside = text[: n - k + 1] == text[k - 1 :]
            out, where = mix(out[inside]), text[: n - k + 1][inside]
        if short and (few := np.flatnonzero((self.count > 0) & (self.count < k))).size:
            extra = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                has = self.count[few] > j
                extra[has] = extra[has] * BASE + h[self.first[few[has]] + j]
            out, where = np.concatenate([out, mix(extra + np.uint64(1))]), np.concatenate([where, few])
            order = np.argsort(where, kind="stable")
            out, where = out[order], where[order]
        return out, where


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every run of w values, by doubling."""
    if len(values) < w:
        return values[:0]
    out, span = values, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sliding_argmin(hashes: np.ndarray, w: int) -> np.ndarray:
    """For every run of w hashes, the place of the smallest by its upper bits, the leftmost of equals.

    The lower bits make room for the place, so that equal runs choose alike wherever they stand.
    """
    bits = np.uint64(21 if len(hashes) <= 1 << 21 else 36)
    key = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    return (sliding_min(key, w) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
