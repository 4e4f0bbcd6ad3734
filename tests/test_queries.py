"""Every registered query with SQL against DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pytest

from docspindle import plans

DATA = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)
