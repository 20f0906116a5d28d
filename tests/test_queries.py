"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import glob
import math
import os

import duckdb
import pytest

from marketlens.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str(tuple(map(plain, r))) for r in df.select(cols).collect())
    if name not in catalog.SQL:
        assert got
        return
    rel = con.execute(catalog.SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    assert got == sorted(str(tuple(plain(r[i]) for i in place)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
