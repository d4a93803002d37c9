"""The corpus queries that SQL expresses, against their SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from ledgerlark.llm import queries

D = "/root/testdata/sf0.001"


def cell(v):
    return "" if v is None else str(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(name, spark):
    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, rel = queries.QUERIES[name](spark, D), con.sql(queries.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    assert sorted(tuple(cell(r[c]) for c in names) for r in df.collect()) == sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
