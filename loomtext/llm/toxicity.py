"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams.

A document's features are the hashed words, word pairs and pairs with one word
between (skip-grams) that occur in it. Training is FTRL-proximal with
per-coordinate rates; the L1 term leaves few weights that aren't 0, which are
all that scoring is sent: at most ``2**bits`` of them.

The model is fitted on at most ``SAMPLE`` labelled rows of at most
``SAMPLE_BYTES`` of text in all, the first in the order of a hash of their ids;
those whose crc32(doc_id as text) mod 5 is 0 are never used. All documents are scored, whole. Labels that are null or not 0 or 1 are
not used; of several labels of one document the largest counts. With no labels
at all every score is 0.5 below: 0. Null texts read as empty; an empty text gets
the model's base rate. Repeated rows are scored alike. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import BASE, Words, buffers, column, mix, slices

BITS = 20
SAMPLE, SAMPLE_BYTES = 12_000, 48 << 20
EPOCHS = 4


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, pair and skip-gram, with repeats."""
    h, text = words.hashes, words.text_of()
    parts, where = [h], [text]
    for gap, salt in ((1, 0x51ED270B), (2, 0x3C6EF372)):
        if len(h) > gap:
            same = text[:-gap] == text[gap:]
            parts.append(mix(h[:-gap][same] * BASE + h[gap:][same] + np.uint64(salt)))
            where.append(text[:-gap][same])
    return np.concatenate(where), (np.concatenate(parts) & np.uint64((1 << bits) - 1)).astype(np.int32)


@dataclass
class Model:
    """Sorted places of the weights that aren't 0, the weights, and the intercept."""

    bits: int
    places: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, words: Words) -> np.ndarray:
        total = np.full(len(words.count), self.intercept)
        if len(self.places) and len(words.hashes):
            dense = np.zeros(1 << self.bits, np.float32)
            dense[self.places] = self.weights
            text, f = features(words, self.bits)
            some = np.flatnonzero(dense[f])
            key = np.unique(text[some] << np.int64(self.bits) | f[some])
            total += np.bincount(key >> self.bits, dense[key & ((1 << self.bits) - 1)], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over rows of distinct features; the last coordinate is the intercept, without L1."""
    size = 1 << bits
    if not len(rows) or labels.min() == labels.max():
        base = float(labels.mean()) if len(rows) else 0.0
        return Model(bits, np.zeros(0, np.int64), np.zeros(0), 20.0 if base == 1 else -20.0)
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, l1)
    penalty[size] = 0

    def weights(f):
        zf = z[f]
        return np.where(np.abs(zf) <= penalty[f], 0.0, -(zf - np.sign(zf) * penalty[f]) / ((beta + np.sqrt(n[f])) / alpha + l2))

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            f = np.append(rows[i], size)
            w = weights(f)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(np.arange(size + 1))
    places = np.flatnonzero(w[:size])
    return Model(bits, places, w[places], float(w[size]))


def _features(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = Words(*buffers(column(part, "text")))
        text, f = features(words, bits)
        key = np.unique(text << np.int64(bits) | f)
        cut = np.searchsorted(key >> bits, np.arange(1, len(words.count)))
        rows = [x.astype(np.int32).tobytes() for x in np.split(key & ((1 << bits) - 1), cut)]
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "toxic"), pa.array(rows, pa.binary())], ["doc_id", "toxic", "f"])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most this many labelled documents outside the held-out fifth, of at most so many bytes of text in all."""
    chosen = (
        labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumns({"place": F.xxhash64("doc_id"), "h": F.xxhash64("text"), "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    few = rows.select("place", "doc_id", "h", "size").orderBy("place", "doc_id", "h").limit(sample).collect()  # at most `sample` rows of numbers
    total = np.cumsum([r["size"] for r in few])
    last = int(np.searchsorted(total, sample_bytes, "right")) - 1
    if last < 0:
        return train([], np.zeros(0), bits)
    # Rows up to the last in this order; of rows equal in all three no more than are due.
    end = F.struct(*(F.lit(few[last][c]).cast("long").alias(c) for c in ("place", "doc_id", "h")))
    due = rows.where(F.struct("place", "doc_id", "h") <= end)
    rows = due.mapInArrow(partial(_features, bits=bits), "doc_id long, toxic int, f binary").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("f")).limit(last + 1).toArrow()
    f = [np.frombuffer(x.as_py(), np.int32) for x in rows["f"]]
    return train(f, np.array(rows["toxic"].to_pylist(), float), bits)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        score = model.score(Words(*buffers(column(part, "text"))))
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(score)], ["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return docs.select("doc_id", "text").mapInArrow(partial(_score, model=model), "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
