"""Every query of the engine against its SQL on the small tables."""

import datetime as dt
import glob
import os

import duckdb
import pytest

from ledgerlark import queries, queries_plans  # noqa: F401

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, dt.datetime):
        return v.isoformat().removesuffix("T00:00:00")
    if isinstance(v, (int, str, dt.date)):
        return str(v)
    return repr(round(float(v), 6)).removesuffix(".0")


def same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    a = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    b = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, db):
    df = queries.QUERIES[name](spark, D)
    if name in queries.SQL:
        same(df, db, queries.SQL[name])
    else:
        assert df.count() > 0
