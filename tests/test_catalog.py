"""Every registered query against the SQL that states its result."""

import math
import os

import duckdb
import pytest

from tarn.plans import catalog


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat().split("+")[0]
    return v if isinstance(v, (int, bool, str, type(None))) else str(v)


@pytest.fixture(scope="session")
def oracle(small):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, oracle, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.ORACLES:
        assert rows
        return
    told = oracle.sql(catalog.ORACLES[name])
    assert sorted(told.columns) == columns
    want = told.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert rows == sorted((tuple(plain(x) for x in r) for r in want), key=repr)
