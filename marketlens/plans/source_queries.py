"""Queries of sources and sinks: the driver's tables are landed as files, read back by the source, and summed up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..operators import leadlag as ll
from ..scratch import new_dir
from ..sources import files as fl
from ..streaming import books as bk
from ..streaming import snapshots as sn
from . import adapters as ad
from .adapters import M, P, T, table
from .forecast_queries import S, snapshots

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def landed(df, label):
    """The folder that lines (value) are written to, with a broken and a blank line in each file."""
    out = new_dir(df.sparkSession, label)
    noise = df.limit(1).select(F.explode(F.array(F.lit("{broken"), F.lit(""))).alias("value"))
    df.unionByName(noise).write.text(out)
    return out


@query("a1_tick_jsonl", f"with {T} select venue, event_type, count(*) as n, round(sum(p), 6) as last_price, round(sum(size) + sum(2 * size), 4) as bid_depth from t group by 1, 2")
def a1(spark, d):
    """Events as lines of landed ticks; prices under and over one, sizes under either name."""
    t = ad.ticks(spark, d)
    text = lambda c: c.cast("string")
    price = F.when(F.col("tick_id") % 2 == 0, text(F.col("last_price"))).otherwise(text(F.col("last_price") * 100 + 1e-9))
    level = lambda share, size, key: F.struct(text(F.col("last_price") * share).alias("price"), text(size).alias(key))
    m = F.struct("venue", text(F.col("market_id")).alias("market_id"), "event_type", text(F.floor(F.col("ts_us") / 1000)).alias("exchange_timestamp"), price.alias("last_price"), F.array(level(0.5, F.col("bid_size"), "size"), level(0.9, 2 * F.col("bid_size"), "size")).alias("bids"))
    raw = fl.read_ticks_jsonl(spark, landed(t.where("last_price > 0.02").select(F.to_json(m).alias("value")), "ticks")).where("market_id is not null")
    small = t.where("last_price <= 0.02").select("venue", "event_type", "last_price", (3 * F.col("bid_size")).alias("total_bid_depth"))
    both = raw.select("venue", "event_type", "last_price", "total_bid_depth").unionByName(small)
    return both.groupBy("venue", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("last_price"), 6).alias("last_price"), F.round(F.sum("total_bid_depth"), 4).alias("bid_depth"))


def _examples(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.create_map(F.lit("price"), F.col("o_totalprice")).alias("features"), (F.col("o_orderkey") % 2).cast("double").alias("target"), ((F.col("o_orderkey") % 10) / 10).alias("predicted"), (F.col("o_orderstatus") == "F").alias("approved"))


@query("a2_examples_jsonl", "select count(*) as n, sum(o_orderkey % 2)::double as target, round(sum(o_orderkey % 10 / 10), 4) as predicted, round(sum(o_totalprice), 2) as price, count(*) filter (o_orderstatus = 'F') as approved from orders")
def a2(spark, d):
    """A folder of examples with broken lines, and one that isn't there."""
    x = fl.read_examples_jsonl(spark, landed(_examples(spark, d).select(F.to_json(F.struct("*")).alias("value")), "examples")).where("run_id is not null")
    x = x.unionByName(fl.read_examples_jsonl(spark, new_dir(spark, "none")))
    return x.agg(F.count("*").alias("n"), F.sum("target").alias("target"), F.round(F.sum("predicted"), 4).alias("predicted"), F.round(F.sum(F.element_at("features", F.lit("price"))), 2).alias("price"), F.count_if("approved").alias("approved"))


@query("a6_append_examples", "select o_orderkey % 7 as k, 2 * count(*) as n, 2 * sum(o_orderkey % 2)::double as target from orders group by 1")
def a6(spark, d):
    """The same examples appended twice."""
    out = new_dir(spark, "training")
    for _ in range(2):
        fl.append_training_examples(_examples(spark, d), out)
    return fl.read_examples_jsonl(spark, out).groupBy((F.col("run_id").cast("long") % 7).alias("k")).agg(F.count("*").alias("n"), F.sum("target").alias("target"))


def _exported(spark, d):
    o = table(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("event_slug"), F.col("o_orderpriority").alias("event_title"), F.lit("live").alias("mode"), F.col("o_orderstatus").alias("status"), ad.micros("o_orderdate").alias("created_us"))
    pairs = ad.pairs(spark, d)
    signals = ll.scan_signals(pairs, ad.ticks(spark, d))
    tables = {"graph_runs": runs, "market_map": ad.markets(spark, d), "ticks": ad.ticks(spark, d), "leadlag_pairs": pairs, "leadlag_signals": signals, "watchlists": runs.where("run_id < 0")}
    out = new_dir(spark, "export")
    fl.export_dataset(tables, out)
    return out


@query("a3_export_dataset", f"with {T}, {P} select 'graph_runs' as \"table\", count(*) as rows, 6::bigint as columns from orders union all select 'market_map', count(*), 7 from part union all select 'ticks', count(*), 7 from t union all select 'leadlag_pairs', count(*), 4 from pr union all select 'watchlists', 0, 3")
def a3(spark, d):
    """Tables of an export read back: columns that a table lacks are there, as nulls."""
    out, parts = _exported(spark, d), []
    for name in ("graph_runs", "market_map", "ticks", "leadlag_pairs", "watchlists"):
        x = spark.read.parquet(f"{out}/{name}")
        parts.append(x.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(len(x.columns)).cast("long").alias("columns")))
    return fl.union_feeds(*parts)


@query("a3_export_values", f"with {T}, {P}, {M} select 'ticks ' || venue as part, count(*) as rows, round(sum(p), 6) as total, max(us)::varchar as last from t group by venue union all select 'market_map', count(*), round(sum(volume), 2), max(tag) from m union all select 'leadlag_pairs', count(*), 0::double, max(pair_id)::varchar from pr union all select 'graph_runs', count(*), 0::double, max(o_orderkey)::varchar from orders")
def a3_values(spark, d):
    """Values of an export read back, in the types of its columns."""
    out = _exported(spark, d)
    read = lambda name: spark.read.schema(fl.export_schema(name)).parquet(f"{out}/{name}")
    part = lambda df, name, total, last: df.agg(F.count("*").alias("rows"), total.alias("total"), last.cast("string").alias("last")).withColumn("part", name)
    zero, longest = F.lit(0.0), lambda c: F.max(F.col(c).cast("long"))
    ticks = read("ticks").groupBy(F.concat(F.lit("ticks "), "venue").alias("part")).agg(F.count("*").alias("rows"), F.round(F.sum("last_price"), 6).alias("total"), F.max("ts_us").cast("string").alias("last"))
    rest = [part(read("market_map"), F.lit("market_map"), F.round(F.sum("volume"), 2), F.max(F.get("tags", F.lit(0)))), part(read("leadlag_pairs"), F.lit("leadlag_pairs"), zero, longest("pair_id")), part(read("graph_runs"), F.lit("graph_runs"), zero, longest("run_id"))]
    for x in rest:
        ticks = ticks.unionByName(x)
    return ticks


@query("a4_saved_tables", f"with {M} select venue, count(*) as markets, round(sum(volume), 2) as volume, 0::double as net, 0::bigint as watched from m group by 1")
def a4_saved(spark, d):
    """Saved tables of an export: those never exported are there in their own types."""
    fl.register_tables(spark, _exported(spark, d), database="exported")
    return spark.sql("select venue, count(*) as markets, round(sum(volume), 2) as volume, (select coalesce(sum(net), 0.0D) from exported.paper_trades where gross > 0) as net, (select count(*) from exported.watchlists where is_featured) as watched from exported.market_map group by venue")


@query("a4_register_tables", f"with {M}, s as (select venue, count(*) as markets, round(sum(volume), 2) as volume from m group by 1) select venue, markets, volume, 0::bigint as trades, 0::bigint as watched, (select count(*) from orders) as runs from s")
def a4(spark, d):
    """Views of an export asked by SQL; of tables without rows, and of those never exported, too."""
    fl.register_tables(spark, _exported(spark, d))
    return spark.sql("select m.*, t.trades, w.watched, r.runs from (select venue, count(*) as markets, round(sum(volume), 2) as volume from market_map group by venue) m cross join (select count(*) as trades from paper_trades) t cross join (select count(*) as watched from watchlists) w cross join (select count(*) as runs from graph_runs) r")


@query("a5_golden", "select p_brand as brand, count(*) as n, round(sum(p_retailprice), 2) as price from part group by 1")
def a5(spark, d):
    """A golden file written and read back."""
    out = new_dir(spark, "golden")
    p = table(spark, d, "part")
    fl.write_golden(p.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price")), out)
    return spark.read.schema("brand string, n long, price double").json(out)


@query("a7_venue_events", "select p_brand as tag, count(*) as markets, round(sum(p_retailprice), 2) as volume, round(sum(0.4), 4)::double as yes from part group by 1")
def a7(spark, d):
    """A venue's feed landed as JSON lines: events with their markets."""
    p = table(spark, d, "part")
    market = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("question"), F.col("p_retailprice").cast("string").alias("volume"), F.lit('["Yes","No"]').alias("outcomes"), F.lit('["0.4","0.6"]').alias("outcomePrices"))
    event = F.struct(F.col("p_partkey").cast("string").alias("slug"), F.lit(True).alias("active"), F.array(F.struct(F.col("p_brand").alias("label"))).alias("tags"), F.array(market, F.struct(*(F.lit("").alias(c) for c in ("id", "question", "volume", "outcomes", "outcomePrices")))).alias("markets"))
    rows = fl.venue_a_rows(fl.read_venue_events(spark, landed(p.select(F.to_json(event).alias("value")), "feed")))
    return rows.groupBy(F.get("tags", F.lit(0)).alias("tag")).agg(F.count("*").alias("markets"), F.round(F.sum("volume"), 2).alias("volume"), F.round(F.sum(F.get("outcome_prices", F.lit(0))), 4).alias("yes"))


@query("g6_summary_board", """with b as (select 'leadlag' as task, 'live' as readiness, count(*)::double as "primary" from events union all select 'forecast', 'next', (count(*) % 5 + 1)::double from orders), c as (select 'orders=' || (select count(*) from orders) || ' part=' || (select count(*) from part) as dataset_rows) select task, readiness, "primary", dataset_rows from b, c""")
def g6(spark, d):
    """Experiments of three tasks appended to a registry table, one of them without examples, beside dataset counts."""
    out = new_dir(spark, "registry")
    n = table(spark, d, "events").agg(F.count("*").alias("net_pnl"), F.lit(20).alias("examples"))
    few = table(spark, d, "orders").agg((F.count("*") % 5 + 1).alias("model_brier"), F.lit(3).alias("examples"))
    none = table(spark, d, "part").agg(F.count("*").alias("model_ndcg"), F.lit(0).alias("queries"))
    old = table(spark, d, "part").agg(F.lit(-1).alias("net_pnl"), F.lit(20).alias("examples"))
    for m, task, at in ((old, "leadlag", 1), (n, "leadlag", 2), (few, "forecast", 1), (none, "ranking", 1)):
        fl.record_experiment(m, task, "v1", out, created_us=at)
    board = fl.benchmark_board(spark.read.parquet(out), fl.dataset_counts({k: table(spark, d, k) for k in ("orders", "part")}))
    rows = F.array_join(F.transform(F.map_entries("dataset_rows"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return board.select("task", "readiness", "primary", rows.alias("dataset_rows"))


@query("l4_refresh_loop", f"with {T} select event_type, count(*) as n, round(sum(p), 6) as last_price from t group by 1")
def l4(spark, d):
    """Ticks that arrive in four files, each batch appended; pairs and signals refreshed on the way."""
    src, out, at = new_dir(spark, "arriving"), new_dir(spark, "ticks"), new_dir(spark, "checkpoint")
    ticks = ad.ticks(spark, d)
    ticks.repartition(4, "tick_id").write.parquet(src)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(src)
    seen = {"pairs": 0, "signals": 0}
    count = lambda k: lambda: seen.update({k: seen[k] + 1})
    q = bk.refresh_loop(stream, lambda batch: batch.write.mode("append").parquet(out), count("pairs"), count("signals"), pairs_every=2, signals_every=1, checkpoint=at, available_now=True)
    q.awaitTermination()
    if not 0 < seen["pairs"] <= seen["signals"]:
        raise AssertionError("pairs and signals were not refreshed")
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("last_price"), 6).alias("last_price"))


@query("l5_collect_snapshots", "select o_custkey as event_slug, count(*) as days, round(sum(v), 2) as volume from (select o_custkey, o_orderdate, max_by(o_totalprice, o_orderkey) as v from orders group by 1, 2) group by 1")
def l5(spark, d):
    """Snapshots that arrive in three batches, in an order of their own: of one slug and time the largest id stays."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("event_slug"), ad.micros("o_orderdate").alias("ts_us"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_totalprice").alias("volume"))
    rows = _collected(spark, d, o)
    return rows.groupBy("event_slug").agg(F.count("*").alias("days"), F.round(F.sum("volume"), 2).alias("volume"))


def _collected(spark, d, rows, batches=3):
    """rows landed as files by snapshot_id and collected in some batches, of more files where there are more orders (one for each 4 MB), so that a task reads no more."""
    files = max(1, -(-ad.size(spark, d, "orders") // (batches * (4 << 20))))
    src, out, at = new_dir(spark, "snapshots"), new_dir(spark, "collected"), new_dir(spark, "checkpoint")
    rows.repartitionByRange(batches * files, "snapshot_id").write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(src)
    sn.collect_snapshots(stream, out, at, available_now=True, buckets=8).awaitTermination()
    return sn.collected_snapshots(spark, out, rows.schema)


@query("l5_collected_labels", f"with {S}, k as (select * from ts qualify row_number() over (partition by event_slug, us order by snapshot_id desc) = 1), kd as (select event_slug, outcome from k where status = 'closed' and price >= 0.99 qualify row_number() over (partition by event_slug order by us desc, snapshot_id desc) = 1) select kd.outcome, count(*) as snapshots, count(distinct event_slug) as slugs from k join kd using (event_slug) group by 1")
def l5_labels(spark, d):
    """Labels of the snapshots collected in three batches."""
    labels = fc.label_families(_collected(spark, d, snapshots(spark, d)))
    return labels.groupBy(F.col("resolved_outcome").alias("outcome")).agg(F.count("*").alias("snapshots"), F.countDistinct("event_slug").alias("slugs"))
