"""Every query of the engine against its SQL in another engine, at the smallest scale."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from corpusloom.plans.catalog import CATALOG

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no benchmark tables here")
@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, other, name):
    q = CATALOG[name]
    df = q.run(spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(map(plain, r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if q.sql is None:
        assert mine, "a query without SQL must at least give rows"
        return
    theirs = other.sql(q.sql)
    assert sorted(theirs.columns) == columns
    place = [theirs.columns.index(c) for c in columns]
    assert mine == sorted(repr(tuple(plain(r[i]) for i in place)) for r in theirs.fetchall())
