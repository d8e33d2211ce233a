"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from stratiform import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return float(f"{v:.9g}") if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches(spark, con, name):
    df = registry.queries()[name](spark, D)
    cols = sorted(df.columns)
    mine = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    other = sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == other


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, D).count() > 0
