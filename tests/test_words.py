"""Words from bytes are those of the columns of functions.text."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions import words as W

ODD = [chr(c) for c in (0x130, 0x131, 0x3A3, 0x3C2, 0x1C4, 0x1C5, 0x2160, 0x2170, 0x24B6, 0x24D0, 0xAA, 0x345, 0x93E, 0x661, 0xB2, 0x20000, 0x1F600, 0x4E2D, 0xA0, 0x85, 0x2028, 0x1C, 0xDF, 0x1E9E, 0xE9, 0xC9, 0x301)]


def texts(n: int = 3000) -> list[str]:
    rng = random.Random(3)
    pool = list("abcsSABCZ09__  \n.-\t") + ODD
    some = ["".join(rng.choice(pool[:19] if i % 3 == 0 else pool) for _ in range(rng.randrange(40))) for i in range(n)]
    # Rows that only their border keeps apart, and one that is long.
    return ["", "a", "B", "bC", "ABc", "", "x" * 200, "status gas pass HTTPServers v2Beta"] + some + ["".join(chr(i) for i in range(0x20, 0x3000)), "\u1C89\uA7DA x", "A" + "İ", "İ", ""]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "i long, text string").repartition(1).sortWithinPartitions("i").localCheckpoint()


def by_row(found, n: int) -> list[list[str]]:
    out = [[] for _ in range(n)]
    for r, w in zip(found[0].tolist(), found[1].to_pylist()):
        out[r].append(w)
    return out


@pytest.mark.parametrize("name", ["terms", "folded_words", "identifier_runs"])
def test_words_are_those_of_the_column(spark, rows, name):
    want = [r["w"] for r in rows.select("i", getattr(T, name)(F.col("text")).alias("w")).orderBy("i").collect()]
    part = pa.array([None, *texts()], pa.string()).slice(1)
    got = by_row({"terms": lambda c: W.terms(c, W.characters(spark)), "folded_words": W.folded, "identifier_runs": W.runs}[name](part), len(want))
    if name == "identifier_runs":
        got = [list(dict.fromkeys(x)) for x in got]
    assert [(t, a) for t, a, b in zip(texts(), got, want) if a != b] == []
    assert W.runs(pa.array([], pa.string()))[1].to_pylist() == W.runs(pa.array([None, ""], pa.string()))[1].to_pylist() == []


def test_identifiers_are_those_of_the_column(rows):
    want = [r["w"] for r in rows.select("i", T.normal_identifier(F.col("text")).alias("w")).orderBy("i").collect()]
    assert W.identifiers(pa.array(texts(), pa.string())).to_pylist() == want
