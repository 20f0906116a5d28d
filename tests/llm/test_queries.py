"""Every text query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from marketlens.llm import queries

from ..test_queries import plain


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.execute(queries.SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    assert sorted(str(tuple(map(plain, r))) for r in df.select(cols).collect()) == sorted(str(tuple(plain(r[i]) for i in place)) for r in rel.fetchall())
