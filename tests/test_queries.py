"""Every registered query against its SQL on the smallest test tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {k: q for k, q in entry_points.queries().items() if k in entry_points.QUERIES}
ORACLE = {k: q for k, q in entry_points.oracle_sql().items() if k in entry_points.QUERIES}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    mine = sorted(str([r[c] for c in columns]) for r in df.collect())
    result = duck.execute(ORACLE[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    theirs = sorted(str([row[order.index(c)] for c in columns]) for row in result.fetchall())
    assert mine == theirs
