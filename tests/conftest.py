"""One session for all tests, and small tables to run queries on."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomtext.session import session, ship

    s = session("local[8]", 8, "4g", "tests")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    if not os.path.isdir(TINY):
        pytest.skip("no test tables here")
    return TINY


@pytest.fixture(scope="session")
def same_rows(spark):
    """Compares a query with its SQL on a folder of tables, as multisets of rows with the columns in order of their names."""
    import duckdb

    def rounded(x):
        if isinstance(x, float):
            return round(x, 5)
        if isinstance(x, list):
            return tuple(rounded(y) for y in x)
        return int(x) if isinstance(x, bool) else x

    def compare(query, sql: str, folder: str) -> None:
        con = duckdb.connect()
        for f in sorted(os.listdir(folder)):
            if f.endswith(".parquet"):
                name, path = f.removesuffix(".parquet"), f"{folder}/{f}"
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        want = sorted((tuple(rounded(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in want.fetchall()), key=repr)
        df = query(spark, folder)
        assert sorted(df.columns) == sorted(columns)
        got = sorted((tuple(rounded(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
        assert len(got) == len(want)
        assert got == want

    return compare
