"""Queries of catalog clean-up, discovery words and review texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions import tokens as tk
from ..operators import review as rv
from ..sources import files as fl
from .adapters import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("b9_venue_b_rows", "select 'T' || p_partkey as market_id, case when p_partkey % 3 = 0 then p_type else p_name end as title, p_size / 100 as yes_bid, p_retailprice as volume, p_partkey % 2 = 0 as is_active from part where p_size > 1 union all select 'T' || p_partkey, case when p_partkey % 3 = 0 then p_type else p_name end, p_size::double, p_retailprice, p_partkey % 2 = 0 from part where p_size <= 1")
def b9(spark, d):
    p = table(spark, d, "part")
    raw = p.select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("ticker"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("title"), F.col("p_type").alias("yes_sub_title"), F.col("p_brand").alias("event_ticker"), F.col("p_size").alias("yes_bid"), F.lit("50").alias("yes_ask"), F.lit("bad").alias("last_price"), F.col("p_retailprice").alias("volume"), F.lit(1).alias("liquidity"), F.lit(0).alias("open_interest"), F.when(F.col("p_partkey") % 2 == 0, "Open").otherwise("settled").alias("status"))
    return fl.venue_b_rows(raw).select("market_id", "title", "yes_bid", "volume", "is_active")


@query("b10_compose_title", "select p_partkey, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then case when list_contains(string_split(p_name, ' '), lower(p_type)) then p_name else p_name || ' ' || p_type end else p_name || ': ' || p_brand || ' settles' end as title from part")
def b10(spark, d):
    p = table(spark, d, "part")
    q = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.concat(F.col("p_brand"), F.lit(" settles")))
    return p.select("p_partkey", nz.compose_title(F.col("p_name"), q, tk.tokens(F.col("p_name")), tk.tokens(q)).alias("title"))


@query("c4_discovery_tokens", f"select item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: length(w) > 3), lambda w: lower(w)), lambda w: not list_contains({_list(tk.DISCOVERY)}, w)))), ' ') as toks from benchmark")
def c4(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(tk.discovery_tokens(F.col("text"))), " ").alias("toks"))


RT = lambda c: f"list_distinct(list_filter(list_transform(list_filter(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda w: length(w) >= 3), lambda w: lower(w)), lambda w: not list_contains({_list(tk.RANKING)}, w)))"


@query("c3_ranking_tokens", f"select doc_id, len({RT('text')}) as n from documents")
def c3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tk.ranking_tokens(F.col("text"))).cast("long").alias("n"))


@query("h5_token_overlap", f"with t as (select conv_id, turn, {RT('text')} as a from conversations) select x.conv_id, x.turn, len(list_intersect(x.a, y.a)) as shared, len(x.a) - len(list_intersect(x.a, y.a)) as own from t x join t y on x.conv_id = y.conv_id and y.turn = x.turn + 1")
def h5(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", tk.ranking_tokens(F.col("text")).alias("a"))
    x = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    return x.select("conv_id", "turn", tk.token_overlap(F.col("a"), F.col("b")).cast("long").alias("shared"), F.size(tk.token_diff(F.col("a"), F.col("b"))).cast("long").alias("own"))


@query("c10_word_hits", f"with t as (select doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w))) as a from documents) select doc_id, len(list_intersect(a, {_list(tk.DRIVERS)})) as drivers from t")
def c10(spark, d):
    arr = F.transform(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return table(spark, d, "documents").select("doc_id", tk.driver_hits(arr).cast("long").alias("drivers"))


@query("g7_watchlists", "select n_name as slug, array_to_string(list('http://x/' || s_suppkey order by s_suppkey), ' ') as urls from supplier join nation on s_nationkey = n_nationkey group by 1")
def g7(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    w = s.groupBy(F.col("n_name").alias("slug")).agg(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: F.struct(F.concat(F.lit("http://x/"), k.cast("string")).alias("url"))).alias("items"))
    return fl.watchlists(w.withColumns({"title": F.col("slug"), "is_featured": F.lit(True)}), True).select("slug", F.array_join("urls", " ").alias("urls"))


@query("h4_union_feeds", "select p_partkey::varchar as market_id, 'a' as venue from part union all select 'T' || p_partkey, 'b' from part")
def h4(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").cast("string").alias("market_id"), F.lit("a").alias("venue"), "p_type")
    return fl.union_feeds(a, p.select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("market_id"), F.lit("b").alias("venue"))).select("market_id", "venue")


@query("b23_normalize_review", "select o_orderkey, '[' || upper(o_orderpriority[3:]) || '] (' || o_custkey || ') late' as issue, least(greatest(case when o_orderkey % 2 = 0 then o_totalprice / 400000 else 0.65 end, 0), 1) as quality from orders")
def b23(spark, d):
    o = table(spark, d, "orders")
    issues = F.array(F.struct(F.substring("o_orderpriority", 3, 99).alias("severity"), F.col("o_custkey").cast("string").alias("ref"), F.lit("late").alias("text")))
    quality = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_totalprice") / 400000).cast("string")).otherwise("unclear")
    return o.select("o_orderkey", nz.normalize_review(issues, quality).alias("r")).select("o_orderkey", F.get("r.issues", F.lit(0)).alias("issue"), "r.quality")


@query("k6_discovery_score", "select p_partkey, round(least(greatest(0.42 + 0.11 * least(p_size % 5, 3) + 0.05 * least(p_size % 7, 4) + case when p_size % 2 = 0 then 0.08 else 0 end + least(log10(p_retailprice + 1) / 18, 0.09) + least(log10(p_retailprice / 2 + 1) / 24, 0.05), 0.45), 0.94), 6) as score from part")
def k6(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(rv.discovery_score(s % 5, s % 7, s % 2 == 0, F.col("p_retailprice"), F.col("p_retailprice") / 2), 6).alias("score"))
