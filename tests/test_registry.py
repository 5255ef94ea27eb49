"""Every registered query with a DuckDB text agrees with it at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare
from ledgerloom import registry

registry.load()

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert compare(rows, df.columns, cur.fetchall(), columns) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
