"""Sequence packing into optimal length buckets.

Documents are measured in token ids, with an end id each, and cut into
sequences of at most ``LONGEST`` ids, so nothing is dropped. From the histogram
of all sequence lengths (at most ``LONGEST`` rows) dynamic programming chooses
the bucket lengths that need the least padding in all. Sequences of a bucket are
padded to its length, and a batch holds as many of them as ``BUDGET`` ids allow.

Within a bucket, sequences are numbered without a global sort: those of a bucket
spread over groups of about ``GROUP`` sequences by a hash, each group is numbered
by itself, and the groups' sizes tell where each begins. So a bucket that holds
most sequences is many small groups. ``batches`` gives the packed ids themselves.

Null texts read as empty: one sequence, the end id alone. Repeated rows and equal
or null ids are documents each. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .encoder import encoder
from .textkit import column, slices

LONGEST = 2048
BUCKETS = 8
BUDGET = 32_768
#: Sequences that are numbered together, about.
GROUP = 20_000
#: Rows of a table that is broadcast.
MOST_BROADCAST = 100_000


def best_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths, ascending, with the least padding for sequences of these lengths; the last is the longest."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    many = np.append(0, np.cumsum(counts))
    cost = np.full((min(buckets, n) + 1, n + 1), np.iinfo(np.int64).max // 2)
    cost[0, 0] = 0
    back = np.zeros(cost.shape, np.int64)
    for b in range(1, len(cost)):
        for j in range(b, n + 1):
            # The last bucket takes lengths i to j - 1. Ids in all are fixed, so padded size is what counts.
            total = cost[b - 1, :j] + (many[j] - many[:j]) * lengths[j - 1]
            back[b, j] = total.argmin()
            cost[b, j] = total[back[b, j]]
    out, j = [], n
    for b in range(int(cost[1:, n].argmin()) + 1, 0, -1):
        out.append(int(lengths[j - 1]))
        j = back[b, j]
    return out[::-1]


def _measured(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for part in slices(batches):
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "h"), pa.array(coder.counts(column(part, "text")) + 1)], ["doc_id", "h", "n"])


def measure(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, h (a hash of the row) and n, its number of ids with the end id."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    return rows.mapInArrow(partial(_measured, path=tokenizer), "doc_id long, h long, n long")


def sequences(sized: DataFrame, longest: int = LONGEST) -> DataFrame:
    """sized (doc_id, h, n) cut into sequences: doc_id, h, piece, start, n_tokens."""
    pieces = F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {longest}"))
    return sized.select("doc_id", "h", "n", F.explode(pieces).alias("piece")).select(
        "doc_id", "h", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).alias("n_tokens")
    )


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Per sequence: doc_id, h (a hash of the row), piece, start, n_tokens, bucket (from 0), bucket_len, batch (from 0 in its bucket), slot, padding."""
    seqs = sequences(scratch.written(measure(docs, tokenizer), "lengths"), longest)
    histogram = seqs.groupBy("n_tokens").count().collect()  # at most `longest` rows
    bounds = best_buckets(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets)
    which = F.lit(max(len(bounds) - 1, 0))
    for i in reversed(range(len(bounds) - 1)):
        which = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(which)
    sizes = F.array(*(F.lit(b) for b in bounds or [1]))
    salts = max(1, sum(r[1] for r in histogram) // GROUP)
    rows = seqs.withColumn("bucket", which).withColumn("salt", F.pmod(F.xxhash64("h", "piece"), F.lit(salts)).cast("int"))
    groups = rows.groupBy("bucket", "salt").count()
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("bucket", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    here = Window.partitionBy("bucket", "salt").orderBy("h", "doc_id", "piece")
    # At most `buckets` rows for each GROUP sequences.
    at = rows.withColumn("k", F.row_number().over(here) - 1).join(F.broadcast(offsets) if salts * buckets <= MOST_BROADCAST else offsets, ["bucket", "salt"])
    at = at.withColumn("bucket_len", sizes[F.col("bucket")].cast("long")).withColumn("k", F.col("before") + F.col("k"))
    room = F.expr(f"greatest(1, {budget} div bucket_len)")
    return at.withColumn("room", room).select(
        "doc_id", "h", "piece", "start", "n_tokens", "bucket", "bucket_len", F.expr("k div room").alias("batch"), F.expr("cast(k % room as int)").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )


def _cut_ids(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """For rows of a document's text and its sequences, the ids of each sequence with the padding after them."""
    coder = encoder(path)
    for part in slices(batches):
        ids, bounds = coder.encode(column(part, "text"), end_id)
        rows, who = [], []
        for i, seqs in enumerate(column(part, "seqs").to_pylist()):
            mine = ids[bounds[i] : bounds[i + 1]]
            for s in seqs:
                out = np.full(s["bucket_len"], end_id, np.int32)
                out[: s["n_tokens"]] = mine[s["start"] : s["start"] + s["n_tokens"]]
                rows.append((s["bucket"], s["batch"], s["slot"], s["n_tokens"], out))
                who.append(i)
        names = ["doc_id", "bucket", "batch", "slot", "n_tokens", "ids"]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([column(part, "doc_id").take(pa.array(who, pa.int64())), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)


def batches(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The ids of what pack() gave for docs: doc_id, bucket, batch, slot, n_tokens, ids (as many as the bucket is long, end ids after the sequence's own). docs with several texts under one id: each text's own."""
    key = F.xxhash64("doc_id", "text").alias("h")
    seqs = packed.groupBy("doc_id", "h").agg(F.collect_list(F.struct("bucket", "batch", "slot", "start", "n_tokens", "bucket_len")).alias("all"))
    # The text of repeated rows is encoded once, for all their sequences.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key).groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    rows = texts.join(seqs, (texts["h"] == seqs["h"]) & texts["doc_id"].eqNullSafe(seqs["doc_id"])).select(texts["doc_id"], "text", F.col("all").alias("seqs"))
    return rows.mapInArrow(partial(_cut_ids, path=tokenizer, end_id=end_id), "doc_id long, bucket int, batch long, slot int, n_tokens long, ids array<int>")
