"""A training corpus from raw documents: five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, near_dup, packing, quality, scratch, suffix_dedup
from loomtext.llm.queries import TOKENIZER, table
from loomtext.session import ship

#: No SQL: weak labels, samples, suffix sorting and token ids have no SQL form.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weak-label classifier, fitted on these documents, rejects."""
    ship(spark)
    return quality.keep_good(docs, quality.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    ship(spark)
    return near_dup.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 200 bytes or more, which any 51 words of four letters have, that stand at two places or more."""
    ship(spark)
    return suffix_dedup.strip_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window (13 words, or a whole shorter item)."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into batches of sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; between two of them the rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.written(docs, f"stage{i}")
    return docs
