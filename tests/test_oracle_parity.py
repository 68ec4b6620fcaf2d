"""Every query with an oracle equals its DuckDB SQL on sf0.001 (rows, names, values)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from rewardframe.session import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = {r["status"]: r["n"] for r in df.collect()}
    # expected counts at sf0.001 (FIXTURES.md)
    assert rows == {"fail": 26, "flaky": 19, "no_solution": 12, "no_tests": 12, "partial": 24, "pass": 32, "Total": 125}


def test_every_query_runs(spark):
    for name, fn in entry.queries().items():
        assert fn(spark, SF).columns, name
