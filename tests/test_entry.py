"""The driver's contract, and every query that has SQL against it on a tiny scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert set(registry.QUERIES) <= entry.queries().keys()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for f in os.listdir(SMALL):
        found.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return found


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", list(registry.SQL))
def test_query_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    shown = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({registry.SQL[name]})").fetchall()
    assert rows == sorted(tuple(map(shown, r)) for r in want)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["doc_id", "score"] and got.count() > 0
