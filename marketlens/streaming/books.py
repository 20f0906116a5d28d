"""Structured Streaming: message streams, the order-book fold, deduplication, refresh loops, rate flags."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import normalize as nz
from ..shipping import ready
from .ordered import in_order

#: What messages write into a market's state: a status and eleven numbers.
FIELDS = ["status", "trade_size", *(f"{s}_{n}" for s in ("yes", "no") for n in ("bid", "bid_size", "ask", "ask_size", "last"))]
STATE = ", ".join(f"{c} {'string' if c == 'status' else 'double'}" for c in FIELDS)
STATES = "market_id string, ts_us long, event_type string, hash string, asset_id string, " + STATE


def parse_messages(lines: DataFrame) -> DataFrame:
    """Messages of text lines (value): a JSON object or an array of them; anything else is dropped."""
    text = F.trim(F.col("value").cast("string"))
    many = F.when(text.startswith("["), F.from_json(text, f"array<struct<{_struct(schemas.MESSAGE)}>>")).when(text.startswith("{"), F.array(F.from_json(text, f"struct<{_struct(schemas.MESSAGE)}>")))
    rows = lines.select(F.explode(many).alias("m")).select("m.*").where("event_type is not null")
    return rows.withColumn("ts_us", F.unix_micros(nz.parse_event_time(F.col("timestamp"), F.timestamp_seconds(F.lit(0)))))


def _struct(ddl: str) -> str:
    return ", ".join(f"{x.strip().split(' ', 1)[0]}:{x.strip().split(' ', 1)[1]}" for x in _split(ddl))


def _split(ddl: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]


def read_message_stream(spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None) -> DataFrame:
    """Messages of landed text files, or of Kafka with the given options."""
    lines = spark.readStream.format("kafka").options(**kafka).load().select("value") if kafka else spark.readStream.text(path)
    return parse_messages(lines)


def with_sides(messages: DataFrame, assets: DataFrame) -> DataFrame:
    """Messages with market_id and side by asset; a resolution by its winning asset. Messages of unknown assets go."""
    key = F.when(F.col("event_type") == "market_resolved", F.col("winning_asset_id")).otherwise(F.col("asset_id"))
    return messages.withColumn("_a", key).join(F.broadcast(assets.select(F.col("asset_id").alias("_a"), F.col("market_id").cast("string").alias("market_id"), "side")) if not assets.isStreaming and assets.count() <= 1_000_000 else assets.select(F.col("asset_id").alias("_a"), F.col("market_id").cast("string").alias("market_id"), "side"), "_a").drop("_a")


def _writes(rows: DataFrame) -> DataFrame:
    """What each message writes into its market's state: null where it leaves a field as it is."""
    num = lambda c: nz.to_float(F.col(c))
    kind, side = F.col("event_type"), F.col("side")
    is_ = lambda *k: kind.isin(*k)
    done, book = is_("market_resolved"), is_("book")
    yes = F.when(side == "yes", 1.0).otherwise(0.0)
    level = lambda x: F.struct(nz.to_float(x["price"]).alias("price"), nz.to_float(F.coalesce(x["size"], x["quantity"])).alias("size"))
    best = {}
    for name, sign in (("bid", 1), ("ask", -1)):
        some = F.filter(F.transform(F.coalesce(f"{name}s", F.array().cast(schemas.LEVELS)), level), lambda x: (x["price"] > 0) | (x["size"] > 0))
        best[name] = F.array_max(F.transform(some, lambda x, i: F.struct((x["price"] * sign).alias("rank"), (-i).alias("i"), x["price"].alias("price"), x["size"].alias("size"))))  # noqa: B023
    x = rows.where(is_("book", "best_bid_ask", "price_change", "last_trade_price", "market_resolved")).withColumns({"_bid": best["bid"], "_ask": best["ask"]})
    top, positive = is_("best_bid_ask", "price_change"), lambda c: F.when(c > 0, c)
    write = {"status": F.when(done, "resolved").when(F.coalesce("status", F.lit("")) != "", F.lower("status")), "trade_size": F.when(is_("price_change", "last_trade_price"), positive(num("size")))}
    for s, value in (("yes", yes), ("no", 1 - yes)):
        mine = side == s
        for name in ("bid", "ask"):
            size = F.when(is_("price_change"), num("size")).otherwise(num(f"{name}_size"))
            write[f"{s}_{name}"] = F.when(done, value).when(book & mine, F.col(f"_{name}.price")).when(top & mine & (num(f"best_{name}") > 0), nz.clip_probability(num(f"best_{name}")))
            write[f"{s}_{name}_size"] = F.when(book & mine, F.col(f"_{name}.size")).when(top & mine, positive(size))
        write[f"{s}_last"] = F.when(done, value).when(mine & (num("price") > 0), nz.clip_probability(num("price")))
    return x.select("market_id", "ts_us", "event_type", "hash", "asset_id", *(write[k].alias(k) for k in FIELDS))


def _as_ticks(x: DataFrame) -> DataFrame:
    """Ticks of states: NO prices complete YES ones, and the last price falls back on the other side or the middle."""
    over = F.col("status") == "resolved"
    other = lambda own, from_: F.when(F.col(own) != 0, F.col(own)).when(over | (F.col(from_) == 0), 0.0).otherwise(nz.clip_probability(1 - F.col(from_)))
    x = x.withColumns({"yes_bid": other("yes_bid", "no_ask"), "yes_ask": other("yes_ask", "no_bid")})
    x = x.withColumns({"no_bid": other("no_bid", "yes_ask"), "no_ask": other("no_ask", "yes_bid")})
    mid = F.when((F.col("yes_bid") != 0) & (F.col("yes_ask") != 0), (F.col("yes_bid") + F.col("yes_ask")) / 2).when(F.col("yes_bid") != 0, F.col("yes_bid")).otherwise(F.col("yes_ask"))
    last = F.when(F.col("yes_last") != 0, F.col("yes_last")).when(over, 0.0).when(F.col("no_last") != 0, nz.clip_probability(1 - F.col("no_last"))).otherwise(mid)
    sequence = F.when(F.coalesce("hash", F.lit("")) != "", F.col("hash")).otherwise(F.concat_ws(":", F.coalesce("asset_id", F.lit("None")), F.col("ts_us").cast("string")))
    either = lambda a, b: F.when(F.col(a) != 0, F.col(a)).otherwise(F.col(b))
    return x.select("market_id", "ts_us", "event_type", sequence.alias("sequence_id"), "status", last.alias("last_price"), "yes_bid", "yes_ask", "no_bid", "no_ask", either("yes_bid_size", "no_ask_size").alias("bid_size"), either("yes_ask_size", "no_bid_size").alias("ask_size"), "trade_size")


def _filled(rows: DataFrame) -> DataFrame:
    """The states of a batch: each field is what the last message up to now wrote into it.

    A window in the order of (time, hash) by market, which spills; no market's messages are gathered.
    """
    order = Window.partitionBy("market_id").orderBy("ts_us", F.col("hash").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("market_id", "ts_us", "event_type", "hash", "asset_id", *(F.coalesce(F.last(k, ignorenulls=True).over(order), F.lit("open") if k == "status" else F.lit(0.0)).alias(k) for k in FIELDS))


def _fill(key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """The same of a market's messages that are due, from the state before them. What is older than that goes, but for books."""
    newest, *before = state or (0, "open", *[0.0] * (len(FIELDS) - 1))
    rows = rows[(rows["ts_us"] >= newest) | (rows["event_type"] == "book")].copy()
    for k, x in zip(FIELDS, before, strict=True):
        kept = rows[k].where(rows[k].notna()).ffill()
        rows[k] = kept.where(kept.notna(), x)
    rows = rows.astype({k: float for k in FIELDS[1:]} | {"ts_us": "int64"})
    rows.insert(0, "market_id", key[0])
    last = [rows[k].iloc[-1] for k in FIELDS] if len(rows) else before
    newest = max([newest, *rows["ts_us"].tolist()])
    return (newest, str(last[0]), *map(float, last[1:])), rows[["market_id", "ts_us", "event_type", "hash", "asset_id", *FIELDS]]


def orderbook_ticks(messages: DataFrame, assets: DataFrame, watermark: str | None = None) -> DataFrame:
    """A full tick for every message that changes its market's book: sides replaced by books, tops by updates, NO prices completing YES ones.

    Messages count in the order of (time, hash); a batch is folded by a window. On a stream with a watermark they wait in the state until it has passed
    them, so that those out of order within it make the ticks that a batch of them makes; later ones are dropped.
    Without one the messages of a trigger count at once, and of those older than the state only books. A market
    without messages for a day is forgotten.
    """
    rows = _writes(with_sides(messages, assets))
    if not messages.isStreaming:
        return _as_ticks(_filled(rows))
    return _as_ticks(in_order(rows, ["market_id"], "ts_us", ["hash"], "newest long, " + STATE, _fill, STATES, watermark))


def ticker_ticks(messages: DataFrame, market_map: DataFrame) -> DataFrame:
    """Ticks of the second venue's ticker messages (market_ticker, price, yes_bid, yes_ask, volume, open_interest, ts): stateless."""
    price = lambda c: nz.cents_or_dollars(nz.to_float(F.col(c)), live=True)
    out = messages.withColumns({"last_price": price("price"), "yes_bid": price("yes_bid"), "yes_ask": price("yes_ask")})
    out = out.withColumns({"no_bid": 1 - F.col("yes_ask"), "no_ask": 1 - F.col("yes_bid"), "ts_us": F.unix_micros(nz.parse_event_time(F.col("ts"), F.timestamp_seconds(F.lit(0))))})
    return out.join(market_map.select(F.col("market_id").alias("market_ticker"), "venue"), "market_ticker")


def _marked(ticks: DataFrame) -> DataFrame:
    """ticks with a hash of their values (_v) and what names them: the sequence id, or the values where it is blank (_s)."""
    values = F.xxhash64("last_price", "yes_bid", "yes_ask", "bid_size", "ask_size", "volume")
    return ticks.withColumns({"_v": values, "_s": F.coalesce(F.nullif(F.trim("sequence_id"), F.lit("")), F.concat(F.lit("#"), values.cast("string")))})


def dedup_ticks(ticks: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Ticks without repeats: of one (venue, market, type, time), those with a sequence id seen before, or with the same six values.

    Blank sequence ids stand for nothing and are told apart by the values' hash. Streams forget keys past the watermark.
    """
    x = _marked(ticks)
    keys = ["venue", "market_id", "event_type", "ts_us"]
    if ticks.isStreaming:
        x = x.withColumn("_t", F.timestamp_micros("ts_us")).withWatermark("_t", watermark)
        return x.dropDuplicatesWithinWatermark([*keys, "_s"]).dropDuplicatesWithinWatermark([*keys, "_v"]).drop("_v", "_s", "_t")
    kept = _kept(x, keys)
    return kept.where("tick_id = _kept").drop("_kept", "_v", "_s")


def _kept(x: DataFrame, keys: list[str]) -> DataFrame:
    """x with _kept: the tick that stands for each, by sequence id first, then by values among those that are left."""
    least = lambda c, k: F.min(c).over(Window.partitionBy(*keys, k))
    x = x.withColumn("_one", least("tick_id", "_s"))
    head = F.col("tick_id") == F.col("_one")
    x = x.withColumn("_two", least(F.when(head, F.col("tick_id")), "_v"))
    return x.withColumn("_kept", least(F.when(head, F.col("_two")), "_s")).drop("_one", "_two")


def dedup_books(ticks: DataFrame, books: DataFrame) -> DataFrame:
    """A book for each tick that dedup_ticks keeps: its own, or where it has none that of its first repeat that has one. books: tick_id and more."""
    keys = ["venue", "market_id", "event_type", "ts_us"]
    stands = _kept(_marked(ticks), keys).select("tick_id", "_kept")
    x = books.join(stands, "tick_id")
    order = Window.partitionBy("_kept").orderBy("tick_id")
    return x.withColumn("_r", F.row_number().over(order)).where("_r = 1").withColumn("tick_id", F.col("_kept")).select(*books.columns)


def _stand(key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[None, pd.DataFrame]:
    """The kept ticks of one time, each with its own book or that of its first repeat that has one."""
    kept: list[list] = []
    by_name, by_value = {}, {}
    for r in rows.to_dict("records"):
        at = by_name.get(r["name"])
        if at is None:
            at = by_value.get(r["value"])
            if at is None:
                at = len(kept)
                by_value[r["value"]] = at
                kept.append([r["row"], r["book"]])
            by_name[r["name"]] = at
        if pd.isna(kept[at][1]):
            kept[at][1] = r["book"]
    return None, pd.DataFrame([(tick, None if pd.isna(book) else book) for tick, book in kept], columns=["row", "book"])


def dedup_with_books(ticks: DataFrame, book: list[str], watermark: str = "10 minutes") -> DataFrame:
    """A stream of ticks (book: columns of their own that are null where a tick has no book) without repeats, as dedup_ticks and dedup_books make of a batch.

    Ticks of one (venue, market, type, time) wait until the watermark has passed that time, so that a repeat's book is there
    whenever within it the repeat comes; they count in the order of tick_id.
    """
    keys = ["venue", "market_id", "event_type", "ts_us"]
    tick, books = (F.to_json(F.struct(*cols)) for cols in ([c for c in ticks.columns if c not in book], book))
    some = F.when(F.coalesce(*(F.col(c).cast("string") for c in book)).isNotNull(), books)
    rows = _marked(ticks).select(*keys, F.col("ts_us").alias("us"), "tick_id", F.col("_s").alias("name"), F.col("_v").alias("value"), tick.alias("row"), some.alias("book"))
    out = in_order(rows, keys, "us", ["tick_id"], "x int", _stand, "row string, book string", watermark, keep_s=0)
    kinds = lambda cols: ", ".join(f"`{c}` {ticks.schema[c].dataType.simpleString()}" for c in cols)
    parsed = out.select(F.from_json("row", kinds([c for c in ticks.columns if c not in book])).alias("t"), F.from_json("book", kinds(book)).alias("b"))
    return parsed.select(*(F.col(f"b.{c}" if c in book else f"t.{c}").alias(c) for c in ticks.columns))


def refresh_loop(stream: DataFrame, each: Callable[[DataFrame], None], pairs: Callable[[], None], signals: Callable[[], None], pairs_every: int = 12, signals_every: int = 3, checkpoint: str | None = None, interval: str = "5 seconds", available_now: bool = False):
    """Starts a query that hands on each batch, and refreshes pairs and signals every so many batches; with available_now it ends with what is there."""

    def run(batch: DataFrame, n: int) -> None:
        each(batch)
        if n % pairs_every == 0:
            pairs()
        if n % signals_every == 0:
            signals()

    out = stream.writeStream.foreachBatch(run)
    out = out.trigger(availableNow=True) if available_now else out.trigger(processingTime=interval)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


#: Hits that each kind of request may have within a window of so many seconds.
TIERS = {"api_write": (60, 12), "api_read": (60, 60), "page": (60, 40)}


def request_tier(method: Column, path: Column) -> Column:
    """The kind of a request: posts to the interface, other requests to it, the two pages; null for all others."""
    at = F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))
    return F.when((method == "POST") & at.startswith("/api/"), "api_write").when(at.startswith("/api/"), "api_read").when(at.isin("/", "/app/"), "page")


def rate_flags(log: DataFrame, tiers: dict[str, tuple[int, int]] = TIERS, burst_s: float = 5, burst_max: int = 20, ban_s: int = 600, watermark: str = "10 seconds") -> DataFrame:
    """Hits (key, ts, tier) that exceed what their tier or, for all of a key's hits together, a burst allows.

    Per such hit: key, kind (the tier or burst), ts, hits within the window that ends with it, and until when the key is
    banned (bursts only). Windows slide with the hits and leave out their start; hits of one time count together. A stream gives the
    same flags, each once the watermark has passed its hit: a key's state holds the hits of the longest window.
    """
    every = {"burst": (burst_s, burst_max)} | tiers
    if log.isStreaming:
        spans = {k: (int(s * 1_000_000), most) for k, (s, most) in every.items()}
        rows = log.select("key", "ts", F.unix_micros("ts").alias("us"), "tier")
        out = in_order(rows, ["key"], "us", ["tier"], "times array<bigint>, tiers array<string>", partial(_flagged, spans), "key string, kind string, us long, hits long", watermark, keep_s=int(max(s for s, _ in every.values())) + 1)
        at = F.timestamp_micros("us")
        return out.select("key", "kind", at.alias("ts"), "hits", F.when(F.col("kind") == "burst", at + F.make_dt_interval(secs=F.lit(float(ban_s)))).alias("until"))
    until = lambda at, kind: F.when(F.lit(kind == "burst"), at + F.make_dt_interval(secs=F.lit(float(ban_s))))
    out = None
    for kind, (seconds, most) in every.items():
        rows = log if kind == "burst" else log.where(F.col("tier") == kind)
        order = Window.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(1 - int(seconds * 1_000_000), 0)
        part = rows.withColumn("hits", F.count("*").over(order)).where(F.col("hits") > most).select("key", F.lit(kind).alias("kind"), "ts", "hits", until(F.col("ts"), kind).alias("until"))
        out = part if out is None else out.unionByName(part)
    return out


def _flagged(spans: dict[str, tuple[int, int]], key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """rate_flags of a key's hits that are due, beside those that its state holds."""
    times, tiers = (np.array(list(state[0]), dtype=np.int64), list(state[1])) if state else (np.array([], dtype=np.int64), [])
    at, tier = np.r_[times, rows["us"].astype("int64")], np.array([*tiers, *rows["tier"]], dtype=object)
    new = np.arange(len(at)) >= len(times)
    out = []
    for kind, (span, most) in spans.items():
        mine = np.full(len(at), True) if kind == "burst" else tier == kind
        t = at[mine]
        hits = np.searchsorted(t, t, "right") - np.searchsorted(t, t - span + 1, "left")
        out += [(key[0], kind, int(x), int(n)) for x, n in zip(t[new[mine] & (hits > most)], hits[new[mine] & (hits > most)], strict=True)]
    held = at > at[-1] - max(span for span, _ in spans.values())
    return (at[held].tolist(), [None if pd.isna(x) else x for x in tier[held]]), pd.DataFrame(out, columns=["key", "kind", "us", "hits"])


OUTCOME = "key string, us long, tier string, outcome string"


def request_outcomes(log: DataFrame, tiers: dict[str, tuple[int, int]] = TIERS, burst_s: float = 5, burst_max: int = 20, ban_s: int = 600, watermark: str = "10 seconds") -> DataFrame:
    """What a limiter answers to each hit (key, ts, tier and, where hits may be, suspicious), in the order of time: one of
    allowed, limited (its tier's window is full), burst and suspicious (either bans the key for ban_s seconds), blocked (the key is banned).

    Only hits that a window has room for count in it, and none while the key is banned, so that an answer depends on the ones
    before it: a key's hits are read one by one, on batches from its sorted rows, on streams once the watermark has passed
    them. The state is the ban and the hits counted in each window, as many as it has room for.
    """
    spans = {k: (int(s * 1_000_000), most) for k, (s, most) in ({"burst": (burst_s, burst_max)} | tiers).items()}
    odd = F.coalesce(F.col("suspicious"), F.lit(False)) if "suspicious" in log.columns else F.lit(False)
    rows = log.select("key", "ts", F.unix_micros("ts").alias("us"), "tier", odd.alias("odd"))
    fold = partial(_answered, spans, ban_s * 1_000_000)
    if log.isStreaming:
        keep = int(max([burst_s, ban_s, *(s for s, _ in tiers.values())])) + 1
        return in_order(rows, ["key"], "us", ["tier", "odd"], "until long, kinds array<string>, times array<bigint>", fold, OUTCOME, watermark, keep_s=keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            for key, part in batch.groupby("key", sort=False):
                state = state if key == at else None
                at = key
                state, out = fold((key,), state, part)
                yield out

    ready(log.sparkSession)
    return rows.where("key is not null").drop("ts").repartition("key").sortWithinPartitions("key", "us", "tier", "odd").mapInPandas(run, OUTCOME)


def _answered(spans: dict[str, tuple[int, int]], ban: int, key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    until, seen = (state[0], {}) if state else (-1, {})
    for kind, t in zip(*state[1:], strict=True) if state else ():
        seen.setdefault(kind, deque()).append(t)

    def room(kind: str, now: int) -> bool:
        span, most = spans[kind]
        window = seen.setdefault(kind, deque())
        while window and window[0] <= now - span:
            window.popleft()
        if len(window) < most:
            window.append(now)
            return True
        return False

    out = []
    for now, tier, odd in zip(rows["us"].tolist(), rows["tier"], rows["odd"], strict=True):
        known = tier in spans and tier != "burst"
        answer = "blocked" if now <= until else "suspicious" if odd else "burst" if not room("burst", now) else "limited" if known and not room(tier, now) else "allowed"
        until = now + ban if answer in ("suspicious", "burst") else until
        out.append((key[0], now, tier if isinstance(tier, str) else None, answer))
    flat = [(k, t) for k, window in seen.items() for t in window]
    return (until, [k for k, _ in flat], [t for _, t in flat]), pd.DataFrame(out, columns=["key", "us", "tier", "outcome"])


def live_totals(rows: DataFrame) -> DataFrame:
    """Totals by status of signals or trades (status, net) as they arrive; run in update mode."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("net").alias("net"))
