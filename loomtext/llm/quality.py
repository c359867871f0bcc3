"""Quality classifier: weak labels, expectation-maximisation, a hashed linear scorer.

Overlapping heuristic labellers each vote good, bad or nothing on a document.
The counts of the vote patterns over all documents (at most 3 to the power of
the labellers) are all that expectation-maximisation needs to estimate how
accurate each labeller is. The posterior of a document's pattern is its weak
label, and a logistic scorer over hashed features is trained on these; it
generalises over the labellers' thresholds and alone judges all documents: one
is kept if its score is 0.5 or more.

The scorer is fitted on at most ``SAMPLE`` different texts, the first in the order
of a hash of them; counts, votes and scores cover every document, whole.
Null texts read as empty. A text without words gets no votes, score 0 and is
rejected. Repeated rows are judged alike. An empty table gives an empty result.
Other columns are not read; rows that are kept keep all of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, buffers, column, mix, slices

SAMPLE = 8_000
SIZE = 1024

_KIND = np.zeros(256, np.uint8)  # 0 letter, 1 upper-case, 2 digit, 3 space, 4 line end, from 5 on punctuation
for _c in range(256):
    _KIND[_c] = 0 if 97 <= _c < 123 or _c > 127 else 1 if 65 <= _c < 91 else 2 if 48 <= _c < 58 else 3 if _c in b" \t" else 4 if _c in b"\r\n" else 5 + _c % 32
_ODD = np.zeros(256, bool)
_ODD[list(b"*$%#&{}<>~^=_\\@+|[]")] = True

LABELLERS = ("symbols", "runs", "capitals", "echo", "variety", "tables", "lengths", "digits", "lines", "shouting")
#: Labellers that only ever vote bad, above this.
BAD_ABOVE = {"symbols": 0.05, "runs": 0.05, "echo": 0.2, "tables": 0.15, "digits": 0.25, "lines": 0.3, "shouting": 0.15}
#: Labellers that say nothing on texts of fewer words.
LEAST_WORDS = {"echo": 5, "lengths": 1, "capitals": 1, "variety": 1, "digits": 30}


def _ratio(a, b):
    return a / np.maximum(b, 1)


def measures(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], Words]:
    """What the labellers look at, for each text."""
    words = Words(data, off)

    def per_text(flags):
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[off[1:]] - sums[off[:-1]]

    n, size = words.count, np.diff(off)
    text = words.text_of()
    letters = per_text(_KIND[data] < 2)
    echo, distinct = np.zeros(len(n)), np.zeros(len(n))
    if len(words.hashes):
        same = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
        echo = np.bincount(text[1:][same], minlength=len(n))
        key = np.lexsort((words.hashes, text))
        h, t = words.hashes[key], text[key]
        new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))
        distinct = np.bincount(t[new], minlength=len(n))
    run = np.zeros(len(data), bool)
    if len(data) > 2:
        run[2:] = _ODD[data[2:]] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    raw = data.tobytes()
    lines = np.zeros(len(n))
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        seen = [x for x in raw[a:b].split(b"\n") if len(x) > 3]
        lines[i] = 1 - len(set(seen)) / len(seen) if len(seen) > 2 else 0
    return {
        "symbols": _ratio(per_text(_ODD[data]), size),
        "runs": _ratio(per_text(run), n),
        "capitals": _ratio(per_text(_KIND[data] == 1), letters),
        "echo": _ratio(echo, n),
        "variety": _ratio(distinct, np.sqrt(n)),
        "tables": _ratio(per_text(data == 124), n),
        "lengths": _ratio(letters, n),
        "digits": _ratio(per_text(_KIND[data] == 2), size),
        "lines": lines,
        "shouting": _ratio(per_text(data == 33), n),
    }, words


def votes(m: dict[str, np.ndarray], n_words: np.ndarray) -> np.ndarray:
    """A row for each text: 0 no vote, 1 good, 2 bad, in the order of LABELLERS."""
    out = np.zeros((len(n_words), len(LABELLERS)), np.int8)
    for j, name in enumerate(LABELLERS):
        x = m[name]
        if name == "variety":
            # Distinct words by the square root of all; of few words, at least half should differ.
            few = n_words < 60
            good, bad = np.where(few, x * x > 0.25 * n_words, x > 3.0), np.where(few, x * x < 0.1 * n_words, x < 2.0)
        elif name == "lengths":
            good, bad = (x > 2.5) & (x < 9), (x < 1.2) | (x > 16)
        elif name == "capitals":
            good, bad = (x < 0.15) | (n_words < 8), (x > 0.3) & (n_words >= 8)
        else:
            good, bad = np.zeros(len(x), bool), x > BAD_ABOVE[name]
        out[:, j] = np.where(good, 1, 0) + np.where(bad, 2, 0)
        out[n_words < LEAST_WORDS.get(name, 3), j] = 0
    out[n_words == 0] = 0
    return out


def hashed(data: np.ndarray, off: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """Hashed features of each text, a row each: its three-byte shapes by frequency, and its measures in steps."""
    kind = _KIND[data].astype(np.int64)
    n = len(off) - 1
    out = np.zeros((n, SIZE), np.float32)
    if len(kind) > 2:
        tri = (kind[:-2] << 12) | (kind[1:-1] << 6) | kind[2:]
        text = np.repeat(np.arange(n), np.diff(off))
        inside = text[:-2] == text[2:]
        cell = (_TRI[tri[inside]] + text[:-2][inside] * SIZE)
        out = np.bincount(cell, minlength=n * SIZE).reshape(n, SIZE).astype(np.float32)
        out /= np.maximum(out.sum(axis=1, keepdims=True), 1)
        np.sqrt(out, out=out)
    for j, name in enumerate(LABELLERS):
        step = np.minimum(np.log2(1 + 64 * np.maximum(m[name], 0)).astype(np.int64), 15)
        cell = mix((step * 64 + j + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SIZE)
        np.add.at(out, (np.arange(n), cell.astype(np.int64)), np.float32(0.5))
    return out


_TRI = (mix(np.arange(1 << 18, dtype=np.uint64) + np.uint64(99)) % np.uint64(SIZE)).astype(np.int64)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns: the share of good texts, and P(vote | class) as [class, labeller, vote]."""
    k = patterns.shape[1]
    # What is held of a heuristic before counting, with the weight of a twentieth of the documents.
    belief = np.empty((2, k, 3))
    belief[0], belief[1] = (0.5, 0.2, 0.3), (0.299, 0.7, 0.001)  # class 0 bad, 1 good
    silent = np.array([name in BAD_ABOVE for name in LABELLERS])[:k]
    belief[0, silent], belief[1, silent] = (0.7, 0, 0.3), (0.999, 0, 0.001)
    p, prior, weight = belief + 1e-9, 0.9, 0.05 * counts.sum() + 1
    for _ in range(rounds):
        good = posterior(patterns, prior, p)
        both = np.stack([(1 - good) * counts, good * counts])
        prior = float(np.clip((both[1].sum() + 0.9 * weight) / (both.sum() + weight), 0.02, 0.98))
        p = weight * belief + 1e-9
        for v in range(3):
            p[:, :, v] += both @ (patterns == v)
        p /= p.sum(axis=2, keepdims=True)
    return prior, p


def posterior(patterns: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    """P(good) of each pattern."""
    at = np.arange(patterns.shape[1])
    log = np.log(p)[:, at, patterns].sum(axis=2) if len(patterns) else np.zeros((2, 0))
    return 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - prior) - log[1] - np.log(prior), -500, 500)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    x = x.astype(np.float32, copy=False)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w.copy(), 0.0
    if not len(x):
        return w, b
    rate = 4.0 / (float(np.einsum("ij,ij->", x, x)) / len(x) + 1)
    for _ in range(rounds):
        lw, lb = w + 0.9 * vw, b + 0.9 * vb
        g = 1 / (1 + np.exp(-np.clip(x @ lw + lb, -35, 35))) - y
        vw = 0.9 * vw - rate * ((x.T @ g.astype(np.float32)) / len(x) + l2 * lw)
        vb = 0.9 * vb - rate * float(g.mean())
        w, b = w + vw, b + vb
    return w, b


@dataclass
class Model:
    prior: float
    votes: np.ndarray
    weights: np.ndarray
    intercept: float

    def accuracy(self) -> dict[str, float]:
        """Estimated share of each labeller's votes that are right."""
        share = np.array([1 - self.prior, self.prior])[:, None]
        right = self.votes[0, :, 2] * share[0] + self.votes[1, :, 1] * share[1]
        said = ((1 - self.votes[:, :, 0]) * share).sum(axis=0)
        return dict(zip(LABELLERS, (right / np.maximum(said, 1e-9)).round(4).tolist()))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = 3 ** np.arange(len(LABELLERS))
    for part in slices(batches):
        m, words = measures(*buffers(column(part, "text")))
        code, n = np.unique(votes(m, words.count) @ weight, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n)], ["code", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = 3 ** np.arange(len(LABELLERS))
    for part in slices(batches):
        data, off = buffers(column(part, "text"))
        m, words = measures(data, off)
        x = hashed(data, off, m)
        code = votes(m, words.count) @ weight
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["code", "x"])


def decode(codes: np.ndarray) -> np.ndarray:
    return (np.asarray(codes, np.int64)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3).astype(np.int64)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts the vote patterns of all documents, and fits the scorer on at most this many."""
    text = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = text.mapInArrow(_patterns, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.array(rows["n"].to_pylist(), float)
    prior, p = estimate(decode(rows["code"].to_pylist() or np.zeros(0)), counts)
    chosen = text.where("text <> ''").withColumn("h", F.xxhash64("text"))
    least = chosen.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    few = chosen.where(F.col("h") <= F.lit(least)).dropDuplicates(["h"]).mapInArrow(_features, "code int, x binary").toArrow() if least is not None else None
    codes = np.array(few["code"].to_pylist(), np.int64) if few else np.zeros(0, np.int64)
    x = np.empty((len(codes), SIZE), np.float32)
    at = 0
    for chunk in few["x"].chunks if few else ():
        data, off = buffers(chunk)
        x[at : at + len(off) - 1] = data.view(np.float32).reshape(-1, SIZE)
        at += len(off) - 1
    few = None
    y = posterior(decode(codes), prior, p)
    w, b = train(x, y)
    return Model(prior, p, w, b)


JUDGED = "votes string, posterior double, score double, keep boolean"


def _judge(batches: Iterator[pa.RecordBatch], model: Model, rest: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    sign = np.array(list("-+x"))
    for part in slices(batches):
        data, off = buffers(column(part, "text"))
        m, words = measures(data, off)
        v = votes(m, words.count).astype(np.int64)
        score = 1 / (1 + np.exp(-np.clip(hashed(data, off, m) @ model.weights + model.intercept, -35, 35))).astype(np.float64)
        weak = posterior(v, model.prior, model.votes)
        score[words.count == 0] = 0
        keep = score >= 0.5
        yield pa.RecordBatch.from_arrays(
            [*(column(part, x) for x in rest), pa.array(["".join(r) for r in sign[v].tolist()], pa.string()), pa.array(weak), pa.array(score), pa.array(keep)],
            [*rest, "votes", "posterior", "score", "keep"],
        )


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, votes (one sign for each labeller: - none, + good, x bad), posterior, score, keep."""
    return docs.select("doc_id", "text").mapInArrow(partial(_judge, model=model, rest=("doc_id",)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {JUDGED}")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*inner).withColumn("text", F.col(inner[docs.columns.index("text")]))
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, docs.schema))
    out = plain.mapInArrow(partial(_judge, model=model, rest=tuple(inner)), f"{schema}, {JUDGED}").where("keep").select(*inner)
    return out.toDF(*docs.columns)
