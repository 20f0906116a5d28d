"""The domain's inputs made from the driver's tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATENCY = 10_800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of a table's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def dealt(df: DataFrame, sf_dir: str, name: str, *keys: str, each: int = 4 << 20) -> DataFrame:
    """df, made of a table, shuffled by keys: into a task for each 4 MB of the table's files where these are more than the session's cores, so that a task's memory doesn't grow with the input."""
    spark = df.sparkSession
    n = -(-size(spark, sf_dir, name) // each)
    return df.repartition(n, *keys) if n > spark.sparkContext.defaultParallelism else df.repartition(*keys)


def micros(c: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p, k = F.col("value") / (F.col("value") + 10), F.get_json_object("props", "$.k").cast("double")
    e = e.select(F.col("event_id").alias("tick_id"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("venue"), F.col("user_id").alias("market_id"), "event_type", micros("ts").alias("ts_us"), F.col("event_id").cast("string").alias("sequence_id"), p.alias("last_price"), F.coalesce(k, F.lit(0.0)).alias("bid_size"), F.col("value").alias("volume"))
    e = e.withColumns({"yes_bid": F.greatest(F.col("last_price") - 0.01, F.lit(0.0)), "yes_ask": F.least(F.col("last_price") + 0.01, F.lit(1.0)), "ask_size": F.col("bid_size")})
    return e.withColumns({"no_bid": 1 - F.col("yes_ask"), "no_ask": 1 - F.col("yes_bid")})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even markets lead the odd ones after them."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("m")).distinct()
    both = ids.where("m % 2 = 0").select(F.col("m").alias("leader_id"), (F.col("m") + 1).alias("m")).join(ids, "m")
    return both.select(F.col("leader_id").alias("pair_id"), F.lit("a").alias("leader_venue"), "leader_id", F.lit("b").alias("follower_venue"), F.col("m").alias("follower_id"), F.when(F.col("leader_id") % 6 == 0, "shared_driver").otherwise("logical_equivalent").alias("pair_type"), F.lit(0.6).alias("causal"), F.lit(LATENCY).alias("expected_latency_seconds"))


T = """t as (select event_id as tick_id, case when user_id % 2 = 0 then 'a' else 'b' end as venue, user_id as market_id, event_type, epoch_us(ts) as us, value / (value + 10) as p,
  greatest(value / (value + 10) - 0.01, 0.0) as yes_bid, least(value / (value + 10) + 0.01, 1.0) as yes_ask, coalesce(regexp_extract(props, '[0-9]+')::double, 0) as size, value as volume from events)"""
P = """ids as (select distinct user_id as m from events), pr as (select x.m as pair_id, x.m as leader_id, y.m as follower_id from ids x join ids y on y.m = x.m + 1 where x.m % 2 = 0)"""


def last_n(n: int) -> str:
    return f"n as (select *, row_number() over (partition by venue, market_id order by us desc, tick_id desc) as rank from t where p > 0 qualify rank <= {n})"


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    worth = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("liquidity"))
    p = p.join(worth, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select(
        F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("venue"), F.col("p_partkey").alias("market_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.lit("").alias("resolution_text"), F.array("p_brand").alias("tags"),
        F.col("p_size").cast("string").alias("resolution_window"), F.col("p_retailprice").alias("volume"), F.coalesce("liquidity", F.lit(0.0)).alias("liquidity"), F.lit(0.0).alias("open_interest"), F.lit(0.5).alias("last_price"), F.col("p_brand").alias("event_slug"), F.lit(True).alias("is_active"),
    )


M = """w as (select l_partkey, sum(l_extendedprice::decimal(18, 2))::double as liquidity from lineitem group by 1),
m as (select case when p_partkey % 2 = 0 then 'a' else 'b' end as venue, p_partkey as market_id, p_name || ' ' || p_type as title, p_brand as tag, p_size::varchar as win, p_retailprice as volume, coalesce(liquidity, 0) as liquidity from part left join w on l_partkey = p_partkey)"""


def page_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as markets: texts of their own, so that few pairs share many words."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.when(F.col("page_id") % 2 == 0, "a").otherwise("b").alias("venue"), F.col("page_id").alias("market_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit("").alias("resolution_text"),
        F.array(F.concat(F.lit("page"), (F.col("page_id") % 9).cast("string"))).alias("tags"), F.concat(F.lit("window"), (F.col("page_id") % 5).cast("string")).alias("resolution_window"), F.length("html").cast("double").alias("volume"),
        ((F.col("page_id") % 7) * 10000.0).alias("liquidity"), F.lit(0.0).alias("open_interest"), F.lit(True).alias("is_active"),
    )
