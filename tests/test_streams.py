"""Streams that come out of order, against batches of the same rows."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from marketlens.streaming import books as bk

T0 = 1_710_000_000_000_000


def streamed(spark, tmp_path, rows, ddl, make, late, flush):
    """rows dealt into files at random and read one a trigger, then flush; what make makes of the stream."""
    rng, src = random.Random(9), tmp_path / "in"
    src.mkdir()
    rows = list(rows)
    rng.shuffle(rows)
    size = -(-len(rows) // 5)
    for k in range(6):
        part = rows[k * size : (k + 1) * size] if k < 5 else [flush]
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(src))
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = make(stream, late).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def test_books_out_of_order(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        kind = rng.choice(["book", "best_bid_ask", "price_change", "last_trade_price", "market_resolved", "other"])
        num = lambda: rng.choice([None, "0", f"{rng.random():.3f}", "x"])
        level = lambda: rng.choice([None, [], [{"price": num(), "size": num()} for _ in range(3)]])
        m = f"m{rng.randint(0, 3)}"
        rows.append({"market_id": m, "side": rng.choice(["yes", "no"]), "event_type": kind, "hash": rng.choice([None, f"h{k}"]), "asset_id": f"{m}-1", "ts_us": T0 + rng.randint(0, 2000) * 1_000_000 + k, "status": rng.choice([None, "", "Open"]), **{c: num() for c in ("price", "size", "best_bid", "best_ask", "bid_size", "ask_size")}, "bids": level(), "asks": level()})
    ddl = "market_id string, side string, event_type string, hash string, asset_id string, ts_us long, status string, price string, size string, best_bid string, best_ask string, bid_size string, ask_size string, bids array<struct<price:string,size:string,quantity:string>>, asks array<struct<price:string,size:string,quantity:string>>"
    assets = spark.createDataFrame([(f"m{k}-1", f"m{k}", s) for k in range(4) for s in ["yes"]], "asset_id string, market_id string, side string")
    far = dict(rows[0], market_id="far", asset_id="m0-1", event_type="price_change", ts_us=T0 + 10**11)
    feed = lambda df: df.drop("market_id", "side").withColumn("winning_asset_id", F.col("asset_id"))
    out = streamed(spark, tmp_path, rows, ddl, lambda df, late: bk.orderbook_ticks(feed(df), assets, late), "1 hour", far)
    flat = spark.read.schema(ddl).json(spark.sparkContext.parallelize(map(json.dumps, rows)))
    want = bk.orderbook_ticks(feed(flat), assets)
    key = lambda df: sorted(map(str, df.where(f"ts_us < {T0 + 10**10}").collect()))
    assert key(out) == key(want) and want.count() > 200


LOG = "key string, us long, tier string, suspicious boolean"


def hits(seed, n=400):
    rng = random.Random(seed)
    spread = lambda key: rng.choice([rng.randint(0, 3000) * 1_000_000, 50_000_000 + rng.randint(0, 6_000_000)]) if key != "c" else rng.randint(0, 900) * 1_000_000
    rows = []
    for _ in range(n):
        key = rng.choice("aabc")
        rows.append({"key": key, "us": T0 + spread(key), "tier": rng.choice(["api_read", "api_write", "page", None]), "suspicious": rng.random() < 0.004})
    return rows


def as_log(df):
    return df.select("key", F.timestamp_micros("us").alias("ts"), "tier", "suspicious")


SMALL = {"api_write": (60, 3), "api_read": (60, 8), "page": (600, 5)}


def test_flags_on_a_stream(spark, tmp_path):
    rows = hits(3)
    flags = lambda df, late="10 seconds": bk.rate_flags(as_log(df), SMALL, burst_max=10, watermark=late)
    out = streamed(spark, tmp_path, rows, LOG, flags, "2 hours", {"key": "far", "us": T0 + 10**12, "tier": None, "suspicious": False})
    want = flags(spark.createDataFrame([tuple(r.values()) for r in rows], LOG))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and {r.kind for r in want.collect()} >= {"burst", "page"}


def answers(rows, tiers, burst, ban=600):
    """A limiter that keeps what it counted, hit by hit."""
    seen, banned, out = {}, {}, []

    def room(name, now, span, most):
        seen[name] = [t for t in seen.get(name, []) if t > now - span * 1_000_000]
        if len(seen[name]) >= most:
            return False
        seen[name].append(now)
        return True

    for r in sorted(rows, key=lambda r: (r["key"], r["us"], r["tier"] is not None, r["tier"] or "", r["suspicious"])):
        k, now, tier = r["key"], r["us"], r["tier"]
        if now <= banned.get(k, -1):
            answer = "blocked"
        elif r["suspicious"] or not room((k, "burst"), now, 5, burst):
            answer = "suspicious" if r["suspicious"] else "burst"
            banned[k] = now + ban * 1_000_000
        else:
            answer = "allowed" if not tier or room((k, tier), now, *tiers[tier]) else "limited"
        out.append((k, now, tier, answer))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_outcomes(spark, tmp_path, seed):
    rows = hits(seed)
    make = lambda df, late="10 seconds": bk.request_outcomes(as_log(df), SMALL, burst_max=10, watermark=late)
    want = answers(rows, SMALL, 10)
    assert {a for *_, a in want} >= {"allowed", "limited", "burst", "blocked"}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], LOG)
    assert sorted((tuple(r) for r in make(df).collect()), key=str) == want
    assert make(df.where("false")).count() == 0
    out = streamed(spark, tmp_path, rows, LOG, make, "2 hours", {"key": "far", "us": T0 + 10**12, "tier": None, "suspicious": False})
    assert sorted((tuple(r) for r in out.collect()), key=str) == want


def test_repeats_bring_books(spark, tmp_path):
    rng = random.Random(5)
    ddl = "tick_id long, venue string, market_id long, event_type string, ts_us long, sequence_id string, last_price double, yes_bid double, yes_ask double, bid_size double, ask_size double, volume double, total_bid_depth double, levels int"
    rows = [{"tick_id": k, "venue": rng.choice("ab"), "market_id": rng.randint(0, 2), "event_type": "t", "ts_us": T0 + rng.randint(0, 12) * 1_000_000, "sequence_id": rng.choice([None, "", " ", "x", "y", "z"]), "last_price": rng.choice([0.5, 0.6]), "yes_bid": 0.1, "yes_ask": 0.2, "bid_size": 1.0, "ask_size": 1.0, "volume": rng.choice([1.0, 2.0]), **rng.choice([{"total_bid_depth": k * 1.5, "levels": 3}, {"total_bid_depth": None, "levels": None}])} for k in range(400)]
    out = streamed(spark, tmp_path, rows, ddl, lambda df, late: bk.dedup_with_books(df, ["total_bid_depth", "levels"], late), "1 hour", dict(rows[0], tick_id=10**6, ts_us=T0 + 10**11))
    ticks = spark.createDataFrame([tuple(r.values()) for r in rows], ddl)
    books = ticks.where("total_bid_depth is not null").select("tick_id", "total_bid_depth", "levels")
    kept = bk.dedup_ticks(ticks).drop("total_bid_depth", "levels")
    want = kept.join(bk.dedup_books(ticks, books), "tick_id", "left").select(ticks.columns)
    assert sorted(map(tuple, out.where("tick_id < 1000000").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_live_totals_on_a_stream(spark, tmp_path):
    """Totals after each of five files: the last update of each status is the batch's total."""
    rng = random.Random(6)
    rows = [{"status": rng.choice(["open", "won", "lost"]), "net": rng.randint(-50, 50) / 4} for _ in range(200)]
    src = tmp_path / "in"
    src.mkdir()
    for k in range(5):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, rows[k * 40 : k * 40 + 40])))
    stream = spark.readStream.schema("status string, net double").option("maxFilesPerTrigger", 1).json(str(src))
    seen = {}
    put = lambda batch, n: seen.update({r.status: (n, r.n, r.net) for r in batch.collect()})
    bk.live_totals(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    want = bk.live_totals(spark.createDataFrame([tuple(r.values()) for r in rows], "status string, net double")).collect()
    assert {k: v[1:] for k, v in seen.items()} == {r.status: (r.n, r.net) for r in want} and max(n for n, _, _ in seen.values()) == 4


def test_store_must_be_named(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        stream = spark.readStream.format("rate").load().select(F.lit("a").alias("key"), F.col("timestamp").alias("ts"), F.lit("page").alias("tier"))
        with pytest.raises(ValueError):
            bk.rate_flags(stream)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", bk.in_order.__globals__["ROCKS"])
