"""Queries against their SQL on rows that the smallest tables lack."""

import datetime as dt

import duckdb
import pytest

from marketlens.plans import catalog

from .test_queries import plain

LARGE = "/root/testdata/sf0.1"


def same(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != LARGE else ''}')")
    df = catalog.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted(str(tuple(map(plain, r))) for r in df.select(cols).collect())
    rel = con.execute(catalog.SQL[name])
    place = [[x[0] for x in rel.description].index(c) for c in cols]
    assert got == sorted(str(tuple(plain(r[i]) for i in place)) for r in rel.fetchall()) != []
    return got


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Prices of zero, with and without a size; pages whose titles have no theme and share no token."""
    folder = str(tmp_path_factory.mktemp("odd"))
    at = dt.datetime(2024, 1, 1)
    events = [(k, at + dt.timedelta(seconds=k), 4, kind, value, f'{{"k": {size}}}') for k, kind, value, size in [(2, "view", 5.0, 7), (4, "view", 0.0, 0), (5, "view", 9.0, 3), (6, "purchase", 0.0, 8), (8, "view", 2.0, 0)]]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    pages = [(k, f"u{k}", f"<title>{t}</title>") for k, t in enumerate(["any", "all", "gold fed", "gold rates", "before", "people"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_empty_themes_are_candidates(spark, odd):
    assert "(0, 1)" in same(spark, odd, "d1_candidate_pairs")


def test_empty_level_has_no_price(spark, odd):
    assert "(0.0, 4, None)" in same(spark, odd, "b12_book_levels")


def test_price_of_zero_is_none(spark, odd):
    same(spark, odd, "l1_orderbook_ticks")


def test_first_candidate_need_not_be_new(spark):
    """More candidates than the ledger opens: the first pair is the first of all of them."""
    same(spark, LARGE, "g2_pair_detail")
