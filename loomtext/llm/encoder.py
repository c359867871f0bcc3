"""Token ids of Arrow text slices, with the tokenizers library.

Texts of ASCII and Latin-1 letters take a fast way: their bytes are lower-cased
and cut at white space with numpy, and every distinct chunk is given to the
library's model once per worker. This is what the whole tokenizer does with such
text: it normalises (no change but lower case), cuts at white space, letters,
digits and the rest, and merges within a piece. All other texts, and those with
a special token's brackets, go through the whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .textkit import LOWER, Prefix, buffers

#: Distinct chunks that a worker remembers before it starts afresh.
MOST_KNOWN = 1_500_000

_PLAIN = np.zeros(256, bool)
_PLAIN[32:127] = _PLAIN[[9, 10, 13, 0xC3]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


def _byte_symbols() -> dict[int, str]:
    """Byte-level spelling of the characters up to U+00FF."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spell = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(spell[b] for b in chr(c).encode()) for c in range(256)}


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Adds chunks, which come in the order of their hashes and are all new."""
        if len(self.keys) + len(chunks) > MOST_KNOWN:
            self.forget()
        call, symbols = self.model.tokenize, self.symbols
        ids = [[t.id for p in _PIECE.findall(c.decode()) for t in call(p.translate(symbols))] for c in chunks]
        size = np.array([len(x) for x in ids], np.int64)
        more = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        while self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(more)] = more
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.first = np.insert(self.first, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.used += len(more)

    def _look_up(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each chunk among the known ones."""
        hashes, at, which = np.unique(Prefix(low).at(start, end), return_index=True, return_inverse=True)
        raw = low.tobytes()
        for _ in range(2):
            place = np.searchsorted(self.keys, hashes)
            known = np.zeros(len(hashes), bool)
            inside = place < len(self.keys)
            known[inside] = self.keys[place[inside]] == hashes[inside]
            if known.all():
                break
            if len(self.keys) + int((~known).sum()) > MOST_KNOWN:
                self.forget()
                known[:] = False
            new = np.flatnonzero(~known)
            self.learn(hashes[new], [raw[a:b] for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())])
        return np.searchsorted(self.keys, hashes)[which]

    def _chunks(self, texts: pa.Array):
        """Lower-cased bytes, chunk spans, each text's first chunk (n + 1), and which texts are plain."""
        data, off = buffers(texts)
        n = len(off) - 1
        low = LOWER[data]
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        odd = ~_PLAIN[data] & ~(after & (data >= 0x80))
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        # Multiplication and division signs are no letters: leave such texts to the tokenizer.
        odd |= after & ((data == 0x97) | (data == 0xB7))
        wide = after & (data >= 0x80) & (data <= 0x9E)
        low[wide] += 32
        bad = np.flatnonzero(odd)
        plain = np.ones(n, bool)
        plain[np.searchsorted(off, bad, "right") - 1] = False
        mask = ~_SPACE[data]
        owner_ok = np.repeat(plain, np.diff(off))
        mask &= owner_ok
        edge = np.zeros(len(mask) + 1, bool)
        edge[off] = True
        before, behind = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
        before[1:], behind[:-1] = mask[:-1], mask[1:]
        start = np.flatnonzero(mask & (~before | edge[:-1]))
        end = np.flatnonzero(mask & (~behind | edge[1:])) + 1
        return low, start, end, np.searchsorted(start, off), plain

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 places where each text's begin. end_id is added to each text."""
        low, start, end, first, plain = self._chunks(texts)
        place = self._look_up(low, start, end) if len(start) else np.zeros(0, np.int64)
        size = self.size[place]
        sums = np.append(0, np.cumsum(size))
        ids = self.flat[np.repeat(self.first[place] - sums[:-1], size) + np.arange(sums[-1])]
        bounds = sums[first]
        extra = {i: self._whole(texts[i].as_py()) for i in np.flatnonzero(~plain).tolist()}
        tail = [] if end_id is None else [end_id]
        if not extra and not tail:
            return ids, bounds
        count = np.diff(bounds) + len(tail)
        for i, x in extra.items():
            count[i] += len(x)
        out_at = np.append(0, np.cumsum(count))
        out = np.empty(out_at[-1], np.uint32)
        if tail:
            out[out_at[1:] - 1] = end_id
        if len(ids):
            moved = np.repeat(out_at[:-1] - bounds[:-1], np.diff(bounds))
            out[np.arange(len(ids)) + moved] = ids
        for i, x in extra.items():
            out[out_at[i] : out_at[i] + len(x)] = x
        return out, out_at

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        low, start, end, first, plain = self._chunks(texts)
        place = self._look_up(low, start, end) if len(start) else np.zeros(0, np.int64)
        out = np.diff(np.append(0, np.cumsum(self.size[place]))[first])
        for i in np.flatnonzero(~plain).tolist():
            out[i] = len(self._whole(texts[i].as_py()))
        return out

    def _whole(self, text: str | None) -> list[int]:
        return self.tokenizer.encode(text or "", add_special_tokens=False).ids


_known: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; it keeps what it has learnt from task to task."""
    if path not in _known:
        _known[path] = Encoder(path)
    return _known[path]
