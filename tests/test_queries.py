"""Core queries against their SQL on the smallest tables, where these are there."""

import glob
import os
from decimal import Decimal

import pandas as pd
import pytest

from ledgerloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def canon(df, cols):
    def cell(v):
        if v is None or not hasattr(v, "__len__") and pd.isna(v):
            return "NULL"
        if isinstance(v, float | int | Decimal) and not isinstance(v, bool):
            return f"{float(v):.6g}"
        return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)

    return sorted(tuple(map(cell, r)) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert canon(got, cols) == canon(want, cols)


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
