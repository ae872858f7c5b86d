"""Every query that SQL can say, held against DuckDB on the same files."""

import datetime
import os

import duckdb
import pytest

from riskloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 4) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(r[names.index(c)]) for c in df.columns) for r in got.fetchall()]
    mine = [tuple(plain(r[c]) for c in df.columns) for r in df.collect()]
    assert sorted(map(repr, mine)) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 11
    assert e.oracle_sql().keys() <= e.queries().keys() and QUERIES.keys() <= e.queries().keys()
