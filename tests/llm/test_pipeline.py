"""The corpus pipeline, stage by stage, and its registration."""

from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from loomtext.llm import queries, scratch


def test_stages_keep_columns_and_take_effect(spark, tiny):
    docs = queries.table(spark, tiny, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    columns, n = docs.dtypes, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = scratch.written(stage(spark, docs, tiny), f"t{i}")
        assert docs.dtypes == columns
        left = docs.count()
        assert 0 < left <= n
        assert left < n or i == 2
        n = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert packed.select("doc_id").distinct().count() == n


def test_stages_on_an_empty_table(spark, tiny):
    docs = queries.table(spark, tiny, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tiny).count() == 0


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert any(x.startswith(f"op{n}_") for x in names)
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(name, spark, tiny):
    df = queries.QUERIES[name](spark, tiny)
    assert df.count() > 0
    assert "doc_id" in df.columns or "page_id" in df.columns
