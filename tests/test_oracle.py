"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from quillspark import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def canon(x):
    if isinstance(x, float):
        return repr(round(x, 9))
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(canon, x)) + "]"
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toArrow()
    want = duck.sql(SQL[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    rows = lambda t: sorted(map(canon, zip(*(t[c].to_pylist() for c in cols), strict=True)))
    assert rows(got) == rows(want)
