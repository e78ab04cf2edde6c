"""Each query against its SQL in another engine, on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import evidence, hosts
from tessera.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


QUERIES, SQL = plans.QUERIES | hosts.QUERIES | evidence.QUERIES, plans.SQL | hosts.SQL | evidence.SQL


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(x[names.index(c)] for c in cols) for x in found.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert sorted(names) == cols
    assert got == want and got
