"""Queries of the source and stream operators, run on the driver's tables as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import leadlag as ll
from ..sources import files as fl
from ..streaming import books as bk
from . import adapters as ad
from .adapters import T, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def lines(spark, d):
    """Each event as a line of JSON: an update of its market's book, by turns of YES and NO, in objects and arrays."""
    e = table(spark, d, "events")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in (("view", "best_bid_ask"), ("click", "price_change"), ("error", "last_trade_price"), ("purchase", "book"), ("signup", "best_bid_ask")) for x in kv)), F.col("event_type"))
    p = F.col("value") / (F.col("value") + 10)
    bid, ask = F.greatest(p - 0.01, F.lit(0.01)), F.least(p + 0.01, F.lit(0.99))
    level = lambda x: F.array(F.struct(x.cast("string").alias("price"), F.get_json_object("props", "$.k").alias("size")))
    m = F.struct(kind.alias("event_type"), F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 2 + 1).cast("string")).alias("asset_id"), (ad.micros("ts") / 1000).cast("long").cast("string").alias("timestamp"), F.col("event_id").cast("string").alias("hash"), p.cast("string").alias("price"), F.get_json_object("props", "$.k").alias("size"), bid.cast("string").alias("best_bid"), ask.cast("string").alias("best_ask"), F.when(F.col("event_type") == "purchase", level(bid)).alias("bids"), F.when(F.col("event_type") == "purchase", level(ask)).alias("asks"))
    return e.select(F.when(F.col("event_id") % 2 == 0, F.to_json(m)).otherwise(F.to_json(F.array(m))).alias("value"))


def assets(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("market_id")).distinct()
    m = ids.select(F.lit("a").alias("venue"), "market_id", F.array(F.concat(F.col("market_id").cast("string"), F.lit("-1")), F.concat(F.col("market_id").cast("string"), F.lit("-2"))).alias("clob_token_ids"), F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"))
    return ll.asset_lookup(m)


KIND = "case event_type when 'click' then 'price_change' when 'error' then 'last_trade_price' when 'purchase' then 'book' else 'best_bid_ask' end"


@query("a8_messages", f"select event_id::varchar as hash, {KIND} as event_type, user_id || '-' || (event_id % 2 + 1) as asset_id, epoch_us(ts) // 1000 * 1000 as ts_us from events")
def a8(spark, d):
    bad = spark.createDataFrame([("PONG",), ("",), ("{not json",)], "value string")
    return bk.parse_messages(lines(spark, d).unionByName(bad)).select("hash", "event_type", "asset_id", "ts_us")


BOOK = f"""ms as (select user_id::varchar as market_id, event_id, event_id::varchar as hash, epoch_us(ts) // 1000 * 1000 as ts_us, {KIND} as kind, event_id % 2 = 0 as y, value / (value + 10) as p, greatest(value / (value + 10) - 0.01, 0.01) as bid, least(value / (value + 10) + 0.01, 0.99) as ask, coalesce(regexp_extract(props, '[0-9]+')::double, 0) as k from events),
wr as (select *, kind in ('best_bid_ask', 'price_change', 'book') as top, case when kind = 'book' or (kind = 'price_change' and k > 0) then k end as size, case when kind in ('price_change', 'last_trade_price') and k > 0 then k end as traded from ms),
st as (select market_id, ts_us, kind as event_type, hash as sequence_id,
  coalesce(last_value(case when y and top then bid end ignore nulls) over w, 0) as yb, coalesce(last_value(case when y and top then ask end ignore nulls) over w, 0) as ya, coalesce(last_value(case when not y and top then bid end ignore nulls) over w, 0) as nb, coalesce(last_value(case when not y and top then ask end ignore nulls) over w, 0) as na,
  coalesce(last_value(case when y then size end ignore nulls) over w, 0) as ys, coalesce(last_value(case when not y then size end ignore nulls) over w, 0) as ns, coalesce(last_value(case when y and p > 0 then p end ignore nulls) over w, 0) as yl, coalesce(last_value(case when not y and p > 0 then p end ignore nulls) over w, 0) as nl, coalesce(last_value(traded ignore nulls) over w, 0) as trade_size
  from wr window w as (partition by market_id order by ts_us, hash rows between unbounded preceding and current row)),
s1 as (select *, case when yb <> 0 then yb when na <> 0 then 1 - na else 0 end as yes_bid, case when ya <> 0 then ya when nb <> 0 then 1 - nb else 0 end as yes_ask from st),
s2 as (select *, case when nb <> 0 then nb when yes_ask <> 0 then 1 - yes_ask else 0 end as no_bid, case when na <> 0 then na when yes_bid <> 0 then 1 - yes_bid else 0 end as no_ask from s1)"""


@query("l1_orderbook_ticks", f"with {BOOK} select market_id, ts_us, event_type, sequence_id, round(case when yl <> 0 then yl when nl <> 0 then 1 - nl when yes_bid <> 0 and yes_ask <> 0 then (yes_bid + yes_ask) / 2 when yes_bid <> 0 then yes_bid else yes_ask end, 9) as last_price, round(yes_bid, 9) as yes_bid, round(yes_ask, 9) as yes_ask, round(no_bid, 9) as no_bid, round(no_ask, 9) as no_ask, case when ys <> 0 then ys else ns end as bid_size, case when ys <> 0 then ys else ns end as ask_size, trade_size from s2")
def l1(spark, d):
    x = bk.orderbook_ticks(bk.parse_messages(lines(spark, d)), assets(spark, d)).drop("status")
    return x.withColumns({c: F.round(c, 9) for c in ("last_price", "yes_bid", "yes_ask", "no_bid", "no_ask")})


@query("l2_ticker_ticks", "select event_id, value / 100 as last_price, greatest(value - 1, 0) / 100 as yes_bid, 1 - greatest(value - 1, 0) / 100 as no_ask from (select event_id, least(value, 99.5) as value from events)")
def l2(spark, d):
    v = F.least(F.col("value"), F.lit(99.5))
    m = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("market_ticker"), (v * 100).alias("x"), v.alias("v"), F.col("ts").cast("string").alias("ts"))
    m = m.select("event_id", "market_ticker", F.when(F.col("v") > 1, F.col("v")).otherwise(F.col("v") / 100).alias("price"), F.when(F.col("v") - 1 > 1, F.col("v") - 1).otherwise(F.greatest(F.col("v") - 1, F.lit(0.0)) / 100).alias("yes_bid"), F.lit(0.5).alias("yes_ask"), "ts")
    maps = table(spark, d, "events").select(F.col("user_id").cast("string").alias("market_id"), F.lit("b").alias("venue")).distinct()
    return bk.ticker_ticks(m, maps).select("event_id", "last_price", "yes_bid", "no_ask")


def _repeated(spark, d):
    """Each tick, a repeat with its sequence id, and one without a sequence id; and books of the last two for even ticks."""
    t = ad.ticks(spark, d)
    again = t.withColumn("tick_id", F.col("tick_id") + 1_000_000_000)
    blank = again.withColumns({"tick_id": F.col("tick_id") + 1_000_000_000, "sequence_id": F.lit(" ")})
    book = lambda df, n: df.where("tick_id % 2 = 0").select("tick_id", (F.col("bid_size") * n).alias("total_bid_depth"))
    own = t.where("tick_id % 4 = 0").select("tick_id", F.col("bid_size").alias("total_bid_depth"))
    return t.unionByName(again).unionByName(blank), own.unionByName(book(again, 2)).unionByName(book(blank, 3))


@query("l3_dedup_ticks", f"with {T} select tick_id from t")
def l3(spark, d):
    return bk.dedup_ticks(_repeated(spark, d)[0]).select("tick_id")


@query("l3_dedup_books", f"with {T} select tick_id, case when tick_id % 4 = 0 then size else 2 * size end as total_bid_depth from t where tick_id % 2 = 0")
def l3_books(spark, d):
    return bk.dedup_books(*_repeated(spark, d))


LOG = "hl as (select user_id as key, epoch_us(ts) as us, case when event_type = 'purchase' then 'api_write' when event_type in ('click', 'error') then 'api_read' when event_type = 'view' then 'page' end as tier from events)"


@query("l6_rate_flags", f"""with {LOG}, b as (select key, 'burst' as kind, us, count(*) over (partition by key order by us range between 14399999999 preceding and current row) as hits from hl),
w as (select key, tier as kind, us, count(*) over (partition by key, tier order by us range between 86399999999 preceding and current row) as hits from hl where tier is not null)
select key, kind, us, hits, us + 600000000 as until_us from b where hits > 1 union all select key, kind, us, hits, null from w where hits > case kind when 'api_write' then 1 when 'api_read' then 3 else 2 end""")
def l6(spark, d):
    x = bk.rate_flags(_log(spark, d), {"api_write": (86_400, 1), "api_read": (86_400, 3), "page": (86_400, 2)}, burst_s=14_400, burst_max=1)
    return x.select("key", "kind", F.unix_micros("ts").alias("us"), "hits", F.unix_micros("until").alias("until_us"))


def _log(spark, d):
    e = table(spark, d, "events")
    method = F.when(F.col("event_type") == "purchase", "POST").otherwise("GET")
    path = F.element_at(F.create_map(*(F.lit(x) for kv in (("view", "/app"), ("click", "/api/v1/runs/"), ("error", "/api/v1/health"), ("purchase", "/api/v1/runs/"), ("signup", "/about/")) for x in kv)), F.col("event_type"))
    return e.select(F.col("user_id").alias("key"), F.timestamp_micros(ad.micros("ts")).alias("ts"), bk.request_tier(method, path).alias("tier"))


@query("l6_request_outcomes", f"""with recursive {LOG}, o as (select *, row_number() over (partition by key order by us, tier nulls first) as n from hl),
s as (select distinct key, 0::bigint as n, -1::bigint as until, []::bigint[] as b, []::bigint[] as w, []::bigint[] as r, []::bigint[] as p, null::bigint as us, null::varchar as tier, null::varchar as outcome from hl union all
 select key, n, case when outcome = 'burst' then us + 3600000000 else until end, case when outcome = 'blocked' then b when outcome = 'burst' then fb else list_append(fb, us) end,
  case when tier = 'api_write' and outcome = 'allowed' then list_append(ft, us) else w end, case when tier = 'api_read' and outcome = 'allowed' then list_append(ft, us) else r end, case when tier = 'page' and outcome = 'allowed' then list_append(ft, us) else p end, us, tier, outcome
 from (select *, case when us <= until then 'blocked' when len(fb) >= 2 then 'burst' when tier is not null and len(ft) >= case tier when 'api_write' then 1 when 'api_read' then 3 else 2 end then 'limited' else 'allowed' end as outcome
  from (select s.key, o.n, until, b, w, r, p, o.us, o.tier, list_filter(b, lambda x: x > o.us - 14400000000) as fb, list_filter(case o.tier when 'api_write' then w when 'api_read' then r else p end, lambda x: x > o.us - 864000000000) as ft from s join o on o.key = s.key and o.n = s.n + 1)))
select key, us, tier, outcome from s where n > 0""")
def l6_outcomes(spark, d):
    """Answers to all requests: windows of ten days and four hours, bans of an hour."""
    log = _log(spark, d).withColumn("key", F.col("key").cast("string"))
    x = bk.request_outcomes(log, {"api_write": (864_000, 1), "api_read": (864_000, 3), "page": (864_000, 2)}, burst_s=14_400, burst_max=2, ban_s=3600)
    return x.select(F.col("key").cast("long").alias("key"), "us", "tier", "outcome")


@query("l7_live_totals", f"with {T} select event_type as status, count(*) as n, round(sum(p), 6) as net from t group by 1")
def l7(spark, d):
    return bk.live_totals(ad.ticks(spark, d).select(F.col("event_type").alias("status"), F.col("last_price").alias("net"))).withColumn("net", F.round("net", 6))


@query("b12_book_levels", "select event_id, round(k * 3, 6) as depth, case when p > 0 or k > 0 then round(1 - p, 9) end as no_price from (select event_id, regexp_extract(props, '[0-9]+')::double as k, value / (value + 10) as p from events)")
def b12(spark, d):
    k, p = F.get_json_object("props", "$.k").cast("double"), F.col("value") / (F.col("value") + 10)
    level = lambda price, size: F.struct(price.cast("string").alias("price"), size.cast("string").alias("size"))
    x = table(spark, d, "events").withColumn("bids", nz.normalize_levels(F.array(level(p / 2, k), level(p, 2 * k), level(F.lit(0.0), F.lit(0.0))), "bid"))
    return x.select("event_id", F.round(nz.depth(F.col("bids")), 6).alias("depth"), F.round(F.get(nz.complement_levels(F.col("bids")), F.lit(0))["price"], 9).alias("no_price"))


@query("b1_numbers", "select event_id, coalesce(try_cast(props as double), 0.0) as props_number, case when value > 1 and value <= 100 then value / 100 else value end as dollars, least(greatest(value / 100, 0), 1) as probability from events")
def b1(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", nz.to_float(F.col("props")).alias("props_number"), nz.cents_or_dollars(F.col("value")).alias("dollars"), nz.clip_probability(F.col("value") / 100).alias("probability"))


@query("b4_event_time", "select event_id, epoch_us(ts) // 1000000 as from_iso, epoch_us(ts) // 1000000 as from_seconds, epoch_us(ts) // 1000000 as from_millis from events")
def b4(spark, d):
    us = ad.micros("ts")
    none, whole = F.timestamp_seconds(F.lit(0)), F.floor(us / 1_000_000)
    at = lambda c: F.floor(F.unix_micros(nz.parse_event_time(c, none)) / 1_000_000)
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, d, "events").select("event_id", at(iso).alias("from_iso"), at(whole.cast("string")).alias("from_seconds"), at((us / 1000).cast("long").cast("string")).alias("from_millis"))


def landed(spark, d):
    """Parts as landed venue events: a market each, with prices and outcomes as JSON text."""
    p = table(spark, d, "part")
    market = F.to_json(F.struct(F.lit("").alias("conditionId"), F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("question"), F.col("p_retailprice").cast("string").alias("volume"), F.lit('["Yes","No"]').alias("outcomes"), F.lit('["0.4","0.6"]').alias("outcomePrices")))
    line = F.concat(F.lit('{"slug":"'), F.col("p_partkey").cast("string"), F.lit('","title":"","category":"","closed":false,"active":true,"volume24hr":"'), F.col("p_retailprice").cast("string"), F.lit('","tags":[{"label":"All"},{"label":"'), F.col("p_brand"), F.lit('"},{"label":"'), F.lower("p_brand"), F.lit('"}],"markets":['), market, F.lit("]}"))
    from .. import schemas

    return p.select(F.from_json(line, schemas.EVENT).alias("e")).select("e.*")


@query("b8_venue_rows", "select p_partkey::varchar as market_id, p_name || ' ' || p_type as title, 'All,' || p_brand as tags, p_retailprice as volume, 0.4::double as yes_price from part")
def b8(spark, d):
    r = fl.venue_a_rows(landed(spark, d))
    return r.select("market_id", "title", F.array_join("tags", ",").alias("tags"), "volume", F.get("outcome_prices", F.lit(0)).alias("yes_price"))


@query("b14_flatten_events", "select p_partkey::varchar as slug, p_partkey::varchar as title, 'open' as status, p_brand as tags, 'Yes,No' as outcomes, 'Other' as category from part")
def b14(spark, d):
    return fl.flatten_events(landed(spark, d)).select("slug", "title", "status", F.array_join("tags", ",").alias("tags"), F.array_join("outcomes", ",").alias("outcomes"), "category")


@query("b27_polled_ticks", "select p_partkey::varchar as market_id, 0.4::double as last_price, 0.4 - 0.01::double as yes_bid, 1 - (0.4 - 0.01::double) as no_ask, case when p_partkey % 2 = 0 then p_size::double else 0 end as bid_size, case when p_partkey % 2 = 0 then 2.0 * p_size else 0 end::double as ask_size from part")
def b27(spark, d):
    """Polled markets, half of them with a book whose depth is taken."""
    r = fl.venue_a_rows(landed(spark, d))
    books = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.lit("a").alias("venue"), F.col("p_partkey").cast("string").alias("market_id"), F.col("p_size").cast("double").alias("total_bid_depth"), (F.col("p_size") * 2.0).alias("total_ask_depth"))
    return fl.polled_to_ticks(r, F.timestamp_seconds(F.lit(0)), books).select("market_id", "last_price", "yes_bid", "no_ask", "bid_size", "ask_size")


@query("a10_trending", "select p_partkey::varchar as slug from part where trim(p_name) <> '' order by p_retailprice desc, slug limit 20")
def a10(spark, d):
    return fl.trending(fl.flatten_events(landed(spark, d)), 20).select("slug")


@query("b20_keys", r"select o_orderkey, lower(o_orderpriority) as key, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g') as slug from orders")
def b20(spark, d):
    return table(spark, d, "orders").select("o_orderkey", nz.market_key(F.col("o_orderpriority")).alias("key"), nz.node_slug(F.col("o_orderpriority")).alias("slug"))


@query("b13_mappable", "select p_partkey, p_retailprice > 0 as mappable from part")
def b13(spark, d):
    m = ad.markets(spark, d).withColumn("outcome_type", F.lit("binary"))
    return m.select(F.col("market_id").alias("p_partkey"), nz.is_mappable(F.struct(*m.columns)).alias("mappable"))


@query("g3_page", "select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def g3(spark, d):
    return fl.page(table(spark, d, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 40).select("o_orderkey")


@query("e19_dataset_counts", "select 'orders' as \"table\", count(*) as rows from orders union all select 'part', count(*) from part union all select 'events', count(*) from events")
def e19(spark, d):
    return fl.dataset_counts({n: table(spark, d, n) for n in ("orders", "part", "events")})


@query("e19_landing_stats", "with r as (select o_orderkey, o_custkey, o_orderstatus, o_orderdate from orders), n as (select 'Order ' || o_orderkey as t, row_number() over (order by o_orderdate desc, o_orderkey desc) as k from r qualify k <= 5) select count(*) as runs, count(distinct o_custkey) as events, count(*) filter (o_orderstatus = 'F') as completed, (select string_agg(t, '|' order by k) from n) as recent_titles from r")
def e19_landing(spark, d):
    o = table(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("event_slug"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("event_title"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), ad.micros("o_orderdate").alias("created_us"))
    return fl.landing_stats(runs).withColumn("recent_titles", F.array_join("recent_titles", "|"))


@query("a11_experiment", "select 'leadlag' as task, count(*)::double as ticks, round(avg(value), 6) as mean_value from events")
def a11(spark, d):
    m = table(spark, d, "events").agg(F.count("*").alias("ticks"), F.avg("value").alias("mean_value"))
    r = fl.record_experiment(m, "leadlag", "v1")
    return r.select("task", F.element_at("metrics", F.lit("ticks")).alias("ticks"), F.round(F.element_at("metrics", F.lit("mean_value")), 6).alias("mean_value"))


@query("e25_registry", "select 'leadlag' as task, round(sum(value), 4) as \"primary\", count(*)::double as baseline from events")
def e25(spark, d):
    m = table(spark, d, "events").agg(F.sum("value").alias("net_pnl"), F.count("*").alias("gross_pnl"))
    return fl.experiment_registry(fl.record_experiment(m, "leadlag", "v1")).select("task", F.round("primary", 4).alias("primary"), "baseline")
