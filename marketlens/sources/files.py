"""Landed files in, exports and registries out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import normalize as nz

#: The tables of an export, each with its columns and the order of rows within a file.
EXPORTS = {
    "graph_runs": (["run_id", "event_slug", "event_title", "mode", "status", "created_us"], ["created_us"]), "watchlists": (["slug", "title", "is_featured"], ["title"]),
    "market_snapshots": (["snapshot_id", "event_slug", "ts_us", "status", "p", "volume", "liquidity", "open_interest"], ["ts_us"]), "resolution_labels": (["snapshot_id", "event_slug", "resolved_outcome", "resolved_probability", "source"], ["snapshot_id"]),
    "experiments": (["task", "title", "dataset_version", "metrics", "created_us"], ["created_us"]), "judgments": (["judgment_id", "run_id", "candidate_key", "usefulness_label", "reviewer_key", "updated_us"], ["run_id"]),
    "consensus": (["run_id", "candidate_key", "label", "agreement_rate", "reviewers", "state"], ["run_id"]), "agent_traces": (["trace_id", "run_id", "stage", "status", "latency_ms", "tokens", "cost_usd", "created_us"], ["created_us"]),
    "market_map": (["venue", "market_id", "title", "tags", "volume", "liquidity", "is_active"], ["venue", "market_id"]), "ticks": (["tick_id", "venue", "market_id", "ts_us", "last_price", "yes_bid", "yes_ask"], ["ts_us"]),
    "books": (["tick_id", "venue", "market_id", "total_bid_depth", "total_ask_depth"], ["tick_id"]), "leadlag_pairs": (["pair_id", "pair_type", "composite", "is_trade_eligible"], ["pair_id"]),
    "leadlag_signals": (["pair_id", "status", "direction", "edge", "cost", "latency_ms", "no_trade_reason"], ["pair_id"]), "paper_trades": (["pair_id", "direction", "status", "entry", "exit", "gross", "net"], ["pair_id"]),
    "forecast_examples": (["snapshot_id", "target", "p", "extremeness", "log_volume", "log_liquidity"], ["snapshot_id"]), "ranking_examples": (["query_id", "candidate_id", "relevance", "baseline", "context"], ["query_id"]),
    "trust_examples": (["run_id", "unsupported_rate", "explained_rate", "citation_rate", "trust"], ["run_id"]),
}


#: Types of the columns of exports that aren't text: the same in every table that has the column.
EXPORT_TYPES = {
    **dict.fromkeys(["snapshot_id", "judgment_id", "trace_id", "tick_id", "pair_id", "created_us", "updated_us", "ts_us", "latency_ms", "tokens", "reviewers", "relevance", "target"], "bigint"),
    **dict.fromkeys(["p", "volume", "liquidity", "open_interest", "resolved_probability", "agreement_rate", "cost_usd", "last_price", "yes_bid", "yes_ask", "total_bid_depth", "total_ask_depth", "composite", "edge", "cost", "entry", "exit", "gross", "net", "extremeness", "log_volume", "log_liquidity", "baseline", "context", "unsupported_rate", "explained_rate", "citation_rate", "trust"], "double"),
    **dict.fromkeys(["is_featured", "is_active", "is_trade_eligible"], "boolean"), "tags": "array<string>", "metrics": "map<string,double>",
}


def export_schema(name: str) -> str:
    """The columns of a table of an export with their types."""
    return ", ".join(f"{c} {EXPORT_TYPES.get(c, 'string')}" for c in EXPORTS[name][0])


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the store that Spark reads it from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).exists(at)


def normalize_ticks(raw: DataFrame) -> DataFrame:
    """Ticks of the landed schema with numbers, probabilities, times and book levels in one shape."""
    price = lambda c: nz.clip_probability(nz.cents_or_dollars(nz.to_float(F.col(c))))
    at = nz.parse_event_time(F.col("exchange_timestamp"), F.coalesce("received_at", F.timestamp_seconds(F.lit(0))))
    out = raw.withColumns({c: price(c) for c in ("last_price", "yes_bid", "yes_ask", "no_bid", "no_ask")} | {c: nz.to_float(F.col(c)) for c in ("bid_size", "ask_size", "trade_size", "volume", "open_interest")})
    sized = lambda c: F.transform(F.coalesce(c, F.array().cast(schemas.LEVELS)), lambda x: F.struct(x["price"].alias("price"), F.coalesce(x["size"], x["quantity"]).alias("size")))
    out = out.withColumns({"exchange_timestamp": at, "event_type": F.coalesce("event_type", F.lit("ticker")), "bids": nz.normalize_levels(sized("bids"), "bid"), "asks": nz.normalize_levels(sized("asks"), "ask")})
    return out.withColumns({"total_bid_depth": nz.depth(F.col("bids")), "total_ask_depth": nz.depth(F.col("asks")), "ts_us": F.unix_micros("exchange_timestamp")})


def read_ticks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return normalize_ticks(spark.read.schema(schemas.TICK).option("mode", "DROPMALFORMED").json(path))


def read_examples_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a JSON-lines file; blank and malformed lines are skipped; no rows where the path isn't there."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.EXAMPLE)
    return spark.read.schema(schemas.EXAMPLE).option("mode", "DROPMALFORMED").json(path)


def read_venue_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with their markets, as landed."""
    return spark.read.schema(schemas.EVENT).json(path)


def venue_a_rows(events: DataFrame) -> DataFrame:
    """A row per market of each event; those without id or question go."""
    rows = events.select(F.col("slug").alias("event_slug"), F.col("title").alias("event_title"), "category", "tags", F.explode("markets").alias("m"))
    key = nz.or_else(F.col("m.conditionId"), F.col("m.id"))
    labels = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<struct<label:string>>")), lambda t: F.trim(t["label"])), lambda t: t != "")
    out = rows.select(F.lit("a").alias("venue"), key.alias("market_id"), F.col("m.slug").alias("market_slug"), "event_slug", "event_title", F.trim("m.question").alias("title"), F.coalesce("category", F.lit("Other")).alias("category"), nz.distinct_ci(labels).alias("tags"), *(nz.to_float(F.col(f"m.{a}")).alias(b) for a, b in (("volume", "volume"), ("liquidity", "liquidity"), ("openInterest", "open_interest"), ("bestBid", "yes_bid"), ("bestAsk", "yes_ask"), ("lastTradePrice", "last_price"))), nz.json_string_list(F.col("m.clobTokenIds")).alias("clob_token_ids"), nz.json_string_list(F.col("m.outcomes")).alias("outcomes"), F.transform(nz.json_string_list(F.col("m.outcomePrices")), lambda p: nz.to_float(p)).alias("outcome_prices"))
    return out.where("market_id <> '' and title <> ''")


def venue_b_rows(markets: DataFrame) -> DataFrame:
    """Flat markets of the second venue: title, prices and sizes from the first field that has one; active by status."""
    first = lambda *cols: F.coalesce(*(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in cols if c in markets.columns), F.lit(""))
    num = lambda *cols: nz.to_float(first(*cols))
    return markets.select(F.lit("b").alias("venue"), first("ticker", "id").alias("market_id"), first("title", "yes_sub_title", "subtitle").alias("title"), first("event_ticker").alias("event_slug"), nz.cents_or_dollars(num("yes_bid_dollars", "yes_bid")).alias("yes_bid"), nz.cents_or_dollars(num("yes_ask_dollars", "yes_ask")).alias("yes_ask"), nz.cents_or_dollars(num("last_price_dollars", "last_price")).alias("last_price"), num("volume_24h", "volume").alias("volume"), num("liquidity").alias("liquidity"), num("open_interest").alias("open_interest"), F.lower(first("status")).isin("open", "active", "trading", "initialized").alias("is_active"))


def flatten_events(events: DataFrame) -> DataFrame:
    """Events as snapshots: status, title (from the slug where empty), tags without all, distinct outcomes, category."""
    labels = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<struct<label:string>>")), lambda t: F.trim(t["label"])), lambda t: (t != "") & (F.lower(t) != "all"))
    outcomes = F.flatten(F.transform(F.coalesce("markets", F.array().cast(events.schema["markets"].dataType)), lambda m: nz.json_string_list(m["outcomes"])))
    status = F.when(F.col("closed"), "closed").when(F.col("active"), "open").otherwise("inactive")
    title = nz.or_else(F.trim("title"), F.initcap(F.replace(F.col("slug"), F.lit("-"), F.lit(" "))))
    return events.select("slug", title.alias("title"), status.alias("status"), nz.distinct_ci(labels).alias("tags"), nz.distinct_ci(outcomes).alias("outcomes"), nz.or_else(F.col("category"), F.lit("Other")).alias("category"), nz.to_float(F.col("volume24hr")).alias("volume"))


def polled_to_ticks(rows: DataFrame, at: Column, books: DataFrame | None = None) -> DataFrame:
    """Ticks of polled market rows (venue_a_rows or venue_b_rows): YES price from outcome prices, else last price, else between bid and ask; bid and ask a cent around it where missing."""
    yes = F.get("outcome_prices", F.greatest(F.array_position(F.transform("outcomes", F.lower), "yes") - 1, F.lit(0)).cast("int")) if "outcome_prices" in rows.columns else F.lit(None).cast("double")
    mid = F.when((F.col("yes_bid") > 0) & (F.col("yes_ask") > 0), (F.col("yes_bid") + F.col("yes_ask")) / 2).otherwise(F.greatest("yes_bid", "yes_ask"))
    price = nz.clip_probability(nz.or_else(F.coalesce(yes, F.lit(0.0)), nz.or_else(F.col("last_price"), mid)))
    out = rows.withColumn("last_price", price)
    out = out.withColumns({"yes_bid": nz.or_else(F.col("yes_bid"), nz.clip_probability(F.col("last_price") - 0.01)), "yes_ask": nz.or_else(F.col("yes_ask"), nz.clip_probability(F.col("last_price") + 0.01))})
    out = out.withColumns({"no_bid": nz.clip_probability(1 - F.col("yes_ask")), "no_ask": nz.clip_probability(1 - F.col("yes_bid")), "ts_us": F.unix_micros(at), "event_type": F.lit("poll")})
    if books is None:
        return out.withColumns({"bid_size": F.col("liquidity"), "ask_size": F.col("liquidity")})
    sums = books.groupBy("venue", "market_id").agg(F.max("total_bid_depth").alias("bid_size"), F.max("total_ask_depth").alias("ask_size"))
    return out.join(sums, ["venue", "market_id"], "left").na.fill(0.0, ["bid_size", "ask_size"])


def union_feeds(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def trending(events: DataFrame, n: int) -> DataFrame:
    """The n most traded events with a slug and a title."""
    return events.where("trim(slug) <> '' and trim(title) <> ''").orderBy(F.desc("volume"), "slug").limit(n)


def source_urls(explicit: DataFrame, watch: DataFrame, runs: DataFrame, trend: DataFrame) -> DataFrame:
    """Distinct normal URLs (url, pos) of four sources, each where it first stands: explicit ones before watchlists, runs and trending ones."""
    parts = [df.select(nz.normalize_url(F.col("url")).alias("url"), F.struct(F.lit(k).alias("rank"), F.col("pos").cast("long").alias("pos")).alias("at")) for k, df in enumerate((explicit, watch, runs, trend))]
    return union_feeds(*parts).where("url <> ''").groupBy("url").agg(F.min("at").alias("at")).orderBy("at")


def watchlists(df: DataFrame, featured: bool | None = None) -> DataFrame:
    """Watchlists by title with their item URLs in order."""
    kept = df if featured is None else df.where(F.col("is_featured") == featured)
    return kept.withColumn("urls", F.transform("items", lambda x: x["url"])).orderBy("title", "slug")


def page(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 50))


# ---- sinks --------------------------------------------------------------------------------------------------------


def export_dataset(tables: dict[str, DataFrame], out: str, fmt: str = "parquet") -> list[str]:
    """Writes each table of EXPORTS that is given, with its columns in their types (nulls for those it lacks), sorted within files; returns their names."""
    done = []
    for name, (cols, order) in EXPORTS.items():
        if name in tables:
            df = tables[name]
            whole = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(EXPORT_TYPES.get(c, "string")).alias(c) for c in cols))
            whole.sortWithinPartitions(*order).write.mode("overwrite").format(fmt).save(f"{out}/{name}")
            done.append(name)
    return done


def register_tables(spark: SparkSession, out: str, fmt: str = "parquet", database: str | None = None) -> list[str]:
    """A view for each table of EXPORTS under out, an empty one of the same columns for those that were not exported; returns the names of the others.

    With a database they are saved tables there, each dropped and made anew over its files; a table without rows is described as a full one is.
    """
    names = []
    if database:
        spark.sql(f"create database if not exists {database} location '{out}/_database'")
    for name in EXPORTS:
        path, there = f"{out}/{name}", _exists(spark, f"{out}/{name}")
        if there:
            names.append(name)
        if database:
            if not there:
                path = f"{out}/_empty/{name}"
                spark.createDataFrame([], export_schema(name)).write.mode("overwrite").format(fmt).save(path)
            spark.sql(f"drop table if exists {database}.{name}")
            spark.sql(f"create table {database}.{name} ({export_schema(name)}) using {fmt} location '{path}'")
        else:
            df = spark.read.schema(export_schema(name)).format(fmt).load(path) if there else spark.createDataFrame([], export_schema(name))
            df.createOrReplaceTempView(name)
    return names


def write_golden(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_training_examples(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def record_experiment(metrics: DataFrame, task: str, version: str, path: str | None = None, title: str = "", notes: str = "", created_us: int = 0) -> DataFrame:
    """The registry row of a one-row table of metrics (numbers and booleans), appended to path unless it is None."""
    numeric = [c for c, t in metrics.dtypes if t in ("boolean", "int", "bigint", "double", "float", "smallint") or t.startswith("decimal")]
    pairs = F.create_map(*(x for c in numeric for x in (F.lit(c), F.col(c).cast("double"))))
    row = metrics.select(F.lit(task).alias("task"), F.lit(title or task).alias("title"), F.lit(version).alias("dataset_version"), pairs.alias("metrics"), F.lit(notes).alias("notes"), F.lit(created_us).cast("long").alias("created_us"))
    if path:
        row.write.mode("append").parquet(path)
    return row


PRIMARY = {"forecast": ("model_brier", "baseline_brier"), "ranking": ("model_ndcg", "baseline_ndcg"), "leadlag": ("net_pnl", "gross_pnl"), "agent_eval": ("required_stage_coverage_rate", "run_coverage_rate")}


def experiment_registry(experiments: DataFrame) -> DataFrame:
    """The newest experiment of each task with its primary metric, its baseline and a readiness class."""
    last = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("created_us"), F.desc("title")))
    pick = lambda k: F.try_element_at("metrics", F.element_at(F.create_map(*(F.lit(x) for t, v in PRIMARY.items() for x in (t, v[k]))), F.col("task")))
    x = experiments.withColumn("_r", last).where("_r = 1").drop("_r").where(F.col("task").isin(*PRIMARY)).withColumns({"primary": pick(0), "baseline": pick(1)})
    n = F.coalesce(F.try_element_at("metrics", F.lit("examples")), F.try_element_at("metrics", F.lit("queries")), F.lit(0.0))
    return x.withColumn("readiness", F.when(n >= 8, "live").when(n > 0, "next").otherwise("empty"))


def benchmark_board(experiments: DataFrame, counts: DataFrame) -> DataFrame:
    """Registry rows of live and next benchmarks, live ones first, each with the map of dataset counts (table, rows)."""
    sizes = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "rows")))).alias("dataset_rows"))  # a row for each table
    return experiment_registry(experiments).where("readiness <> 'empty'").crossJoin(F.broadcast(sizes)).orderBy(F.when(F.col("readiness") == "live", 0).otherwise(1), "task")


def landing_stats(runs: DataFrame, k: int = 5) -> DataFrame:
    """One row: how many runs, events and finished runs there are, and the titles of the k newest."""
    newest = runs.orderBy(F.desc("created_us"), F.desc("run_id")).limit(k).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("created_us")).alias("at"), (-F.col("run_id")).alias("id"), "event_title"))), lambda x: x["event_title"]).alias("recent_titles"))
    return runs.agg(F.count("*").alias("runs"), F.countDistinct("event_slug").alias("events"), F.count_if(F.col("status") == "completed").alias("completed")).crossJoin(newest)  # one row each


def dataset_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table and rows, a row for each given table."""
    return union_feeds(*(df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in tables.items()))
