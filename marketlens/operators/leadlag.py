"""Lead-lag analytics: tick alignment, stability, pair scores, signals and a paper-trade ledger.

Times are long columns ts_us, microseconds since the epoch. A series is keyed by (venue, market_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import asset_hits, driver_hits, shared_topics, theme_tokens, token_df, token_overlap, tokens, topic_tokens
from ..scratch import kept, settled
from .joins import grid_join

# Weights of pair types.
PAIR_WEIGHTS = {"logical_equivalent": 1.0, "shared_driver": 0.9, "narrative_spillover": 0.75}


# ---- series -------------------------------------------------------------------------------------------------------


def last_n_ticks(ticks: DataFrame, n: int, keys: tuple[str, ...] = ("venue", "market_id")) -> DataFrame:
    """The n newest ticks with a positive price of each series, with rank 1 for the newest."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts_us"), F.desc("tick_id")))
    return ticks.where("last_price > 0").withColumn("rank", rank).where(F.col("rank") <= n)


def pair_series(pairs: DataFrame, ticks: DataFrame, role: str) -> DataFrame:
    """Ticks of each pair's market in a role (leader or follower), keyed by pair_id."""
    keys = pairs.select("pair_id", F.col(f"{role}_venue").alias("venue"), F.col(f"{role}_id").alias("market_id"))
    return ticks.join(keys, ["venue", "market_id"])


def nearest_asof(leader: DataFrame, follower: DataFrame, by: str, tolerance_s: float | str, most: int = 1_000_000) -> DataFrame:
    """Each leader tick with the follower tick nearest in time, at most tolerance_s (a number, or a column of leader) away; the earlier one on ties.

    One shuffle by key and one sort: both series are put in time order, and each leader tick takes the last follower
    tick before it and the first after it. Of followers at one time the last by id counts as the one before. A key with more than
    `most` ticks is cut into slices of time of about so many, each of which gets the last follower before it and the first after it.
    """
    side = lambda df, kind: df.select(by, "ts_us", F.lit(kind).alias("kind"), "tick_id", F.struct("ts_us", "tick_id", "last_price").alias("tick"), (F.col(tolerance_s) if isinstance(tolerance_s, str) and kind else F.lit(None if isinstance(tolerance_s, str) else float(tolerance_s))).cast("double").alias("tol"))
    both = _sliced(side(follower, 0).unionByName(side(leader, 1)), by, most)
    order = Window.partitionBy(by, "slice").orderBy("ts_us", "kind", "tick_id")
    own = F.when(F.col("kind") == 0, F.col("tick"))
    both = both.withColumn("prev", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("next", F.first(own, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))).where("kind = 1")
    before, after = F.col("ts_us") - F.col("prev.ts_us"), F.col("next.ts_us") - F.col("ts_us")
    near = F.when(F.col("prev").isNull() | (after < before), F.col("next")).otherwise(F.col("prev"))
    out = both.withColumn("f", near).where("f is not null").where(F.abs(F.col("f.ts_us") - F.col("ts_us")) <= F.col("tol") * 1_000_000)
    return out.select(by, F.col("ts_us").alias("l_us"), F.col("tick.tick_id").alias("l_id"), F.col("tick.last_price").alias("l_price"), F.col("f.ts_us").alias("f_us"), F.col("f.tick_id").alias("f_id"), F.col("f.last_price").alias("f_price"))


def _sliced(both: DataFrame, by: str, most: int, fine: int = 1000) -> DataFrame:
    """both series with slice: 0, or for keys of more than `most` rows one of up to `fine` slices of time by quantiles; and copies of the followers next to each slice's borders."""
    large = kept(both.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > most), "large-series")
    n = large.count()
    if not n:
        return both.withColumn("slice", F.lit(0))
    side = F.broadcast(large) if n <= 100_000 else large
    marks = both.join(side, by).groupBy(by).agg(F.percentile_approx("ts_us", [k / fine for k in range(1, fine)], 10_000).alias("_q"), F.max("_n").alias("_n"))
    # Every so many of the fine quantiles, so that a slice holds about `most` rows.
    step = F.greatest(F.floor(F.lit(fine * most) / F.col("_n")), F.lit(1))
    marks = kept(marks.select(by, F.array_distinct(F.filter("_q", lambda x, i: (i + 1) % step == 0)).alias("_q")), "slices")
    bounds = F.broadcast(marks) if n <= 10_000 else marks
    placed = both.join(bounds, by, "left").withColumn("slice", F.when(F.col("_q").isNull(), 0).otherwise(F.size(F.filter("_q", lambda x: x <= F.col("ts_us")))))
    mine = F.when(F.col("kind") == 0, F.col("tick"))
    ends = placed.where("_q is not null").groupBy(by, "slice").agg(F.max(mine).alias("last"), F.min(mine).alias("first"))
    slices = Window.partitionBy(by).orderBy("slice")  # of a large key, one row a slice
    before = F.last("last", ignorenulls=True).over(slices.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(slices.rowsBetween(1, Window.unboundedFollowing))
    guests = ends.withColumns({"_before": before, "_after": after}).select(by, "slice", F.explode(F.array_compact(F.array("_before", "_after"))).alias("tick"))
    guests = guests.select(by, F.col("tick.ts_us").alias("ts_us"), F.lit(0).alias("kind"), F.col("tick.tick_id").alias("tick_id"), "tick", F.lit(None).cast("double").alias("tol"), "slice")
    return placed.drop("_q").unionByName(guests)


def drop_repeats(aligned: DataFrame, by: str = "pair_id") -> DataFrame:
    """Aligned rows without those that repeat the row before."""
    order = Window.partitionBy(by).orderBy("l_us", "l_id")
    same = (F.lag("l_id").over(order) == F.col("l_id")) & (F.lag("f_id").over(order) == F.col("f_id"))
    return aligned.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same").drop("_same")


def aligned_deltas(aligned: DataFrame, by: str = "pair_id") -> DataFrame:
    """Changes from one aligned row to the next, with price gap and lead seconds of the later; the first row of a pair has null changes."""
    order = Window.partitionBy(by).orderBy("l_us", "l_id")
    return aligned.select(
        "*", (F.col("l_price") - F.lag("l_price").over(order)).alias("l_delta"), (F.col("f_price") - F.lag("f_price").over(order)).alias("f_delta"),
        F.abs(F.col("l_price") - F.col("f_price")).alias("gap"), ((F.col("f_us") - F.col("l_us")) / 1_000_000).alias("lead_s"),
    )


def stability_score(agg: DataFrame) -> DataFrame:
    """score and readiness of aggregated deltas (aligned, moves, sign, l_avg, f_avg, first, avg_gap, l_ticks, f_ticks)."""
    ratio = F.greatest(F.lit(0.0), 1 - F.abs(F.col("l_avg") - F.col("f_avg")) / F.greatest("l_avg", "f_avg", F.lit(1e-6)))
    score = F.col("sign") * 0.35 + ratio * 0.2 + F.least(F.col("first") * 1.1, F.lit(1.0)) * 0.2 + F.greatest(F.lit(0.0), 1 - F.col("avg_gap") / 0.2) * 0.15 + F.least(F.col("aligned") / 6, F.lit(1.0)) * 0.1
    status = (
        F.when((F.col("l_ticks") < 4) | (F.col("f_ticks") < 4), "needs_history").when(F.col("aligned") < 3, "needs_alignment").when(F.col("moves") == 0, "flat_series")
        .when((F.col("aligned") < 6) | (F.col("moves") < 4), "collect_more").when((F.col("first") < 0.5) | (F.col("sign") < 0.55), "watch_only").otherwise("ready")
    )
    scored = agg.withColumn("readiness_status", status)
    early = F.col("readiness_status").isin("needs_history", "needs_alignment", "flat_series")
    return scored.withColumn("score", F.when(early, F.lit(0.0)).otherwise(F.round(score, 4)))


def stability(pairs: DataFrame, ticks: DataFrame, latency_s: str = "expected_latency_seconds", history: int = 24) -> DataFrame:
    """Per pair: how steadily its leader moves first. Pairs without ticks need history."""
    newest = last_n_ticks(ticks, history).drop("rank")
    leader, follower = (pair_series(pairs, newest, r) for r in ("leader", "follower"))
    window = pairs.select("pair_id", F.greatest(F.col(latency_s) * 4, F.lit(60)).alias("tol"), F.greatest(F.col(latency_s) * 2, F.lit(30)).alias("reach"))
    aligned = drop_repeats(nearest_asof(leader.join(window.select("pair_id", "tol"), "pair_id"), follower, "pair_id", "tol"))
    deltas = aligned_deltas(aligned).join(window, "pair_id")
    move = (F.abs("l_delta") > 1e-6) & (F.abs("f_delta") > 1e-6)
    first = move & (F.col("lead_s") > 0) & (F.col("lead_s") <= F.col("reach"))
    mean = lambda x, when=move: F.avg(F.when(when, x))
    agg = deltas.groupBy("pair_id").agg(
        F.count("*").alias("aligned"), F.count_if(move).alias("moves"), mean(F.when(F.signum("l_delta") == F.signum("f_delta"), 1.0).otherwise(0.0)).alias("sign"),
        mean(F.abs("l_delta")).alias("l_avg"), mean(F.abs("f_delta")).alias("f_avg"), mean(first.cast("double")).alias("first"),
        F.avg(F.when(F.col("l_delta").isNotNull(), F.col("gap"))).alias("avg_gap"), F.avg(F.when(first, F.col("lead_s"))).alias("avg_lead_s"),
    )
    counts = lambda df, name: df.groupBy("pair_id").agg(F.count("*").alias(name))
    out = pairs.select("pair_id").join(agg, "pair_id", "left").join(counts(leader, "l_ticks"), "pair_id", "left").join(counts(follower, "f_ticks"), "pair_id", "left")
    return stability_score(out.na.fill(0))


def leader_noise(ticks: DataFrame, n: int = 8, keys: tuple[str, ...] = ("venue", "market_id")) -> DataFrame:
    """Mean absolute change among the n newest ticks, without the newest change, of each series."""
    order = Window.partitionBy(*keys).orderBy("rank")
    change = F.abs(F.col("last_price") - F.lead("last_price").over(order))
    return last_n_ticks(ticks, n, keys).withColumn("change", change).where("rank > 1 and change is not null").groupBy(*keys).agg(F.avg("change").alias("noise"))


# ---- lookups ------------------------------------------------------------------------------------------------------


def attach_market(ticks: DataFrame, market_map: DataFrame) -> DataFrame:
    """Ticks with their market's columns; null where the map has none."""
    return ticks.join(market_map, ["venue", "market_id"], "left")


def asset_lookup(market_map: DataFrame) -> DataFrame:
    """asset_id -> (venue, market_id, side) from clob_token_ids and outcomes, for markets of two tokens or more.

    The yes token is that of the outcome beginning with y, else the first; the no token likewise with n, else the second.
    """
    place = lambda prefix, default: F.coalesce(F.nullif(F.array_position(F.transform("outcomes", lambda x: F.substring(F.lower(x), 1, 1)), prefix), F.lit(0)), F.lit(default)) - 1
    sides = F.array(*(F.struct(F.get("clob_token_ids", place(p, d).cast("int")).alias("asset_id"), F.lit(s).alias("side")) for p, d, s in (("y", 1, "yes"), ("n", 2, "no"))))
    rows = market_map.where(F.size("clob_token_ids") >= 2).select("venue", "market_id", F.explode(sides).alias("a"))
    return rows.select("a.asset_id", "venue", "market_id", "a.side").where("asset_id is not null")


def latest_after(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """Trades with the newest tick of their follower at or after opened_us; trades without one are left out."""
    keyed = ticks.select(F.col("venue").alias("follower_venue"), F.col("market_id").alias("follower_id"), F.struct("ts_us", "tick_id", "last_price", "yes_bid", "no_bid").alias("x"))
    # The newest tick of a series serves all of its trades that it doesn't precede.
    newest = keyed.groupBy("follower_venue", "follower_id").agg(F.max("x").alias("x"))
    return trades.join(newest, ["follower_venue", "follower_id"]).where("x.ts_us >= opened_us")


def attach_depth(ticks: DataFrame, books: DataFrame | None) -> DataFrame:
    """Ticks with depth: their book's (the deepest, where there are several), else bid and ask size."""
    own = F.col("bid_size") + F.col("ask_size")
    if books is None:
        return ticks.withColumn("depth", own)
    sums = books.groupBy("tick_id").agg(F.max(F.col("total_bid_depth") + F.col("total_ask_depth")).alias("_book"))
    return ticks.join(sums, "tick_id", "left").withColumn("depth", F.coalesce("_book", own)).drop("_book")


def deactivate_missing(current: DataFrame, synced: DataFrame, keys: list[str]) -> DataFrame:
    """current with is_active false for rows whose keys synced lacks; venues of which synced has no row stay as they are."""
    flag = current.join(synced.select(*keys).distinct().withColumn("_in", F.lit(True)), keys, "left")
    if "venue" in keys:
        flag = flag.join(synced.select("venue").distinct().withColumn("_v", F.lit(True)), "venue", "left")
    else:
        flag = flag.withColumn("_v", F.lit(True))
    gone = F.col("_in").isNull() & F.col("_v").isNotNull()
    return flag.withColumn("is_active", F.when(gone, F.lit(False)).otherwise(F.col("is_active"))).select(*current.columns)


def not_yet(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(existing.select(*keys), keys, "left_anti")


def select_markets(market_map: DataFrame, pairs: DataFrame, venue: str, limit: int = 10, active_only: bool = False) -> DataFrame:
    """The limit best markets of a venue in pairs, by eligibility and score of their best pair."""
    ends = pairs.select(*(F.col(f"leader_{k}").alias(k) for k in ("venue", "id")), "is_trade_eligible", "composite", "is_active")
    ends = ends.unionByName(pairs.select(*(F.col(f"follower_{k}").alias(k) for k in ("venue", "id")), "is_trade_eligible", "composite", "is_active"))
    best = ends.where(F.col("is_active") | F.lit(not active_only)).groupBy("venue", "id").agg(F.max(F.struct(F.col("is_trade_eligible").cast("int").alias("e"), "composite")).alias("b"))
    rows = market_map.where(F.col("venue") == venue).join(best.withColumnRenamed("id", "market_id"), ["venue", "market_id"])
    return rows.orderBy(F.desc("b.e"), F.desc("b.composite"), "market_id").limit(limit).drop("b")


# ---- pairs --------------------------------------------------------------------------------------------------------


def with_tokens(markets: DataFrame) -> DataFrame:
    """Markets (title, resolution_text, tags, resolution_window) with the token sets that pair scores need."""
    text = [F.col("title"), F.col("resolution_text"), F.concat_ws(" ", "tags")]
    sets = markets.withColumns({"toks": tokens(*text), "theme": theme_tokens(*text), "title_theme": F.array_sort(theme_tokens(F.col("title"))), "topics": topic_tokens(*text), "window_toks": tokens(F.col("resolution_window"))})
    return sets.withColumns({"drivers": driver_hits(F.col("toks")), "assets": asset_hits(F.col("toks"))})


SIDE = ["venue", "market_id", "toks", "theme", "title_theme", "topics", "window_toks", "drivers", "assets", "liquidity", "volume", "open_interest"]
SETS = ["toks", "theme", "title_theme", "topics", "window_toks", "drivers", "assets"]
OWN = ["venue", "market_id", "liquidity", "volume", "open_interest"]


def candidate_pairs(left: DataFrame, right: DataFrame, mode: str = "blocked", min_score: float = 0.38, stability: float = 1.0) -> DataFrame:
    """Pairs of left and right markets (with_tokens) that could reach the least composite score.

    blocked: pairs that share a token, and pairs of markets with empty title themes; no other pair can score 0.38. bounded: pairs that
    could reach min_score with at most this stability, by what they must share for it (bounded_pairs): a token that many
    markets have makes few of them. cross: all pairs, for small catalogs.
    """
    if mode == "bounded":
        return bounded_pairs(left, right, min_score, stability)
    if mode == "cross":
        name = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in SIDE))
        return name(left, "l").crossJoin(name(right, "r"))
    return members(meet(*(_blocked_keys(x) for x in (alike(left), alike(right)))), SIDE)


def similar_pairs(left: DataFrame, right: DataFrame, min_score: float | None = None, stability: float = 1.0) -> DataFrame:
    """pair_similarity of candidate pairs (bounded where there is a min_score, else blocked), with what pair_direction needs and no token sets.

    Markets of equal token sets are compared once for all (alike), as numbers of words; pairs that can't reach min_score aren't made.
    """
    a, b = alike(left), alike(right)
    known = vocabulary(a, b)
    a, b = numbered(a, known), numbered(b, known)
    if min_score is None:
        pairs = pair_similarity(meet(_blocked_keys(a, "_toks"), _blocked_keys(b, "_toks"), among="_"))
    else:
        pairs = pair_similarity(meet(*_bounded_keys(a, b, min_score, stability), among="_"))
        pairs = pairs.where(_weighted(_most_causal(), F.lit(stability)) >= min_score - 1e-9)
    return members(pairs, [*OWN, "drivers", "assets"])


def alike(markets: DataFrame, most: int = 256) -> DataFrame:
    """Markets (with_tokens) of equal token sets as one row with their members, most of them at most; id numbers the rows."""
    n = F.row_number().over(Window.partitionBy(*SETS).orderBy("market_id"))
    x = markets.select(*OWN, *SETS, F.floor((n - 1) / most).alias("_part"))
    x = x.groupBy(*SETS, "_part").agg(F.collect_list(F.struct(*OWN)).alias("members")).drop("_part")
    return settled(x.withColumn("id", F.monotonically_increasing_id()), "alike")


def members(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs of rows of alike as pairs of markets, with these columns of either side and all others but the sets."""
    rest = [c for c in pairs.columns if c[:2] not in ("l_", "r_")]
    both = [f"{p}_{c}" for p in "lr" for c in cols if c not in OWN]
    out = pairs.select(*rest, *both, "r_members", F.explode("l_members").alias("_l")).select(*rest, *both, "_l", F.explode("r_members").alias("_r"))
    return out.select(*(F.col(f"_{p}.{c}").alias(f"{p}_{c}") if c in OWN else F.col(f"{p}_{c}") for p in "lr" for c in cols), *rest)


def vocabulary(left: DataFrame, right: DataFrame) -> DataFrame:
    """A number (code) and a frequency (df) for each token of rows of alike, tokens of windows included."""
    both = left.select("toks", "window_toks").unionByName(right.select("toks", "window_toks")).withColumn("toks", F.array_union("toks", "window_toks"))
    return settled(token_df(both, "toks").withColumn("code", F.monotonically_increasing_id()), "frequencies")


def numbered(units: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of alike with their sets as codes of a vocabulary, the rarest first but for titles, as _toks, _theme, _title_theme, _topics and _window_toks."""
    words = units.select("id", F.explode(F.array_union("toks", "window_toks")).alias("token")).join(known, "token")
    words = words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token", "code"))).alias("_words"))  # as many as a title has
    m = units.join(words, "id", "left").withColumn("_words", F.coalesce("_words", F.array().cast(words.schema["_words"].dataType)))
    among = lambda c: F.transform(F.filter("_words", lambda x: F.array_contains(F.col(c), x["token"])), lambda x: x["code"])
    m = once(m, {f"_{c}": among(c) for c in ("toks", "theme", "title_theme", "topics", "window_toks")}).drop("_words")
    return m.withColumns({"_title_theme": F.array_sort("_title_theme"), "_drivers": F.col("drivers"), "_assets": F.col("assets")})


def _blocked_keys(units: DataFrame, by: str = "toks") -> DataFrame:
    bare = F.when(F.size("title_theme") == 0, F.array(F.xxhash64(F.lit("")))).otherwise(F.array().cast("array<bigint>"))
    return units.withColumn("_keys", F.concat(F.transform(by, lambda x: F.xxhash64(F.lit(0), x)), bare))


def meet(left: DataFrame, right: DataFrame, cell: int = 1000, among: str = "") -> DataFrame:
    """Pairs of left and right rows (alike's, and an array _keys) that share a key, once each, with their sets (or those whose names begin with among).

    A pair is taken at the first key it shares, where the join finds it, so that pairs are neither shuffled nor joined to their rows
    again: only rows are, once for each of their keys that the other side has too. Keys of many pairs come first, so that few pairs have
    many keys to look at before theirs. Heavy keys are spread over tasks (grid_join).
    """
    sides = [settled(m.select("id", "members", "_keys", *(F.col(f"{among}{c}").alias(c) for c in SETS)), "rows") for m in (left, right)]
    keyed = [m.select("id", F.explode("_keys").alias("key")) for m in sides]
    count = lambda x, n: x.groupBy("key").agg(F.count("*").alias(n))
    met = settled(count(keyed[0], "_nl").join(count(keyed[1], "_nr"), "key"), "met")
    # Numbered in their order: numbers take less room in a shuffle than hashes.
    met = settled(met.orderBy(F.desc(F.col("_nl") * F.col("_nr")), "key").withColumn("code", F.monotonically_increasing_id()), "met")

    def by_key(m: DataFrame, k: DataFrame, p: str) -> DataFrame:
        first = k.join(met, "key").groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("_order"))
        m = m.drop("_keys").join(first, "id")
        m = settled(m.select("_order", *(F.col(c).alias(f"{p}_{c}") for c in ["members", *SETS])), f"keys-{p}")
        m = m.select("*", F.posexplode("_order").alias("_at", "key"))
        return m.withColumn(f"{p}_before", F.slice("_order", F.lit(1), F.col("_at"))).drop("_order", "_at")

    pairs = grid_join(*(by_key(m, k, p) for m, k, p in zip(sides, keyed, "lr", strict=True)), ["key"], cell, 2_000_000, met.select(F.col("code").alias("key"), "_nl", "_nr"))
    new = (F.size("l_before") == 0) | (F.size("r_before") == 0) | ~F.arrays_overlap("l_before", "r_before")
    return pairs.where(new).select(*(f"{p}_{c}" for p in "lr" for c in ["members", *SETS]))


def _jaccard_keys(rule: int, arr: Column, t: float, is_left: bool, classes: int = 20) -> Column:
    """Keys by which sets of tokens (the rarest first) with a Jaccard similarity of t or more meet.

    Sets of n and m tokens must share t (n + m) / (1 + t) of them, so that one of these is among the first tokens of either, all but
    that number less one. Sizes are taken by powers of two: a set has keys for each class of sizes that its partner may have.
    """
    n = F.size(arr)
    own = F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")

    def keys(c: Column) -> Column:
        low = F.pow(F.lit(2.0), c)
        shared = F.ceil(t * (n + F.greatest(low, t * n)) / (1 + t) - 1e-9)
        fits = (2 * low - 1 >= t * n - 1e-9) & (low * t <= n + 1e-9)
        first = F.slice(arr, F.lit(1), F.when(fits, F.greatest(n - shared + 1, F.lit(0))).otherwise(0).cast("int"))
        a, b = (own, c) if is_left else (c, own)
        return F.transform(first, lambda x: F.xxhash64(F.lit(rule), a, b, x))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(classes)), keys))


def _bounds(min_score: float, stability: float) -> dict[str, float | None]:
    """What pairs must have in common to reach min_score, from the weights of pair_similarity, pair_direction and pair_composite.

    Pairs of the two heavier types share two topics, a title, or tokens by the thresholds of their type. A narrative pair
    needs 0.35 semantic + 0.3 causal + 0.2 resolution >= need. Without a topic and with little theme in common its causal score is 0.35 at most:
    then all rests on its tokens (tokens). With one topic in common the semantic score is 0.22: then the resolution must come
    from the window or titles, or the causal score from drivers and assets: how much these must add, with the same window
    (window) and without (strength); None where they can't add enough.
    """
    need = min_score / PAIR_WEIGHTS["narrative_spillover"] - 0.15 * stability - 1e-9
    one = need - 0.35 * 0.22
    least = lambda resolution: (one - 0.2 * resolution) / 0.3
    some = lambda causal: causal - 0.42 if causal <= 0.95 else None
    return {"tokens": min((need - 0.3 * 0.35 - 0.2) / 0.35, 0.22), "window": some(least(1.0)), "strength": some(least(0.8 * 0.3))}


def bounded_pairs(left: DataFrame, right: DataFrame, min_score: float = 0.38, stability: float = 1.0, cell: int = 1000) -> DataFrame:
    """candidate_pairs by what a pair must share to reach min_score with at most this stability; no pair that can is lost.

    One join on keys: tokens of sets that are similar enough (all tokens, themes, titles), the rarest first, so that a set's commonest
    tokens are no keys; equal titles, of which the empty ones are one class; all but the commonest of a market's topics, as two are
    shared or the topic goes with a window or with drivers and assets. Heavy keys are spread over tasks (grid_join). Scores
    that low bounds rule out nothing for (tokens under 0.05) ask for mode="blocked".
    """
    a, b = alike(left), alike(right)
    known = vocabulary(a, b)
    return members(meet(*_bounded_keys(numbered(a, known), numbered(b, known), min_score, stability), cell), SIDE)


def _bounded_keys(left: DataFrame, right: DataFrame, min_score: float, stability: float) -> list[DataFrame]:
    """Rows of alike (numbered) with the keys of bounded_pairs."""
    b = _bounds(min_score, stability)
    if b["tokens"] < 0.05:
        raise ValueError("min_score is too low for bounds: use blocked or cross")
    most = left.select(F.size("toks").alias("n")).unionByName(right.select(F.size("toks").alias("n"))).agg(F.max("n")).first()[0] or 1
    classes = most.bit_length()

    def keyed(m: DataFrame, is_left: bool) -> DataFrame:
        m = once(m, {"_p": 0.18 * F.col("drivers") + 0.05 * F.col("assets"), "_a": 0.08 * F.col("assets"), "_title": F.filter("_toks", lambda x: F.array_contains("_title_theme", x))})
        by = lambda rule, arr: F.transform(arr, lambda x: F.xxhash64(F.lit(rule), x))
        parts = [_jaccard_keys(1, F.col("_toks"), b["tokens"], is_left, classes), _jaccard_keys(2, F.col("_theme"), min(0.15, b["tokens"]), is_left, classes), _jaccard_keys(3, F.col("_title"), 0.3, is_left, classes)]
        parts += [F.array(F.xxhash64(F.lit(4), F.array_join("title_theme", " "))), by(5, F.slice("_topics", 1, F.greatest(F.size("_topics") - 1, F.lit(0))))]
        windows = F.flatten(F.transform("_topics", lambda x: F.transform("_window_toks", lambda w: F.xxhash64(x, w))))
        # Either side may have the words: strong ones meet all of the other side, whichever is the left.
        for least, rule, what in ((b["window"], 6, windows), (b["strength"], 8, F.col("_topics"))):
            if least is not None and least <= 0:
                parts.append(by(rule, what))
            elif least is not None:
                some = F.when(F.greatest("_p", "_a") >= least / 2, by(rule if is_left else rule + 1, what)).otherwise(F.array().cast("array<bigint>"))
                parts += [some, by(rule + 1 if is_left else rule, what)]
        return m.withColumn("_keys", F.array_distinct(F.concat(*parts)))

    return [keyed(left, True), keyed(right, False)]


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """df with cols, each computed once a row however often later expressions and filters use it.

    A generator of one row stands between: the optimizer copies no expression past it.
    """
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))).alias("_once")
    return df.select("*", made).select(*df.columns, *(F.col(f"_once.{n}") for n in cols))


def pair_similarity(pairs: DataFrame) -> DataFrame:
    """semantic, resolution, title_sim and pair_type of candidate pairs (of with_tokens: themes and topics are among the tokens, titles' themes among the themes)."""
    size = lambda p, k: F.size(f"{p}_{k}")
    both = lambda k: token_overlap(F.col(f"l_{k}"), F.col(f"r_{k}"))
    # Themes and topics are parts of all tokens: where they are as many on either side, they are the same, and are not compared again.
    part = lambda k, whole, shared: F.when((size("l", k) == size("l", whole)) & (size("r", k) == size("r", whole)), F.col(shared)).otherwise(both(k))
    alone = (size("l", "window_toks") <= 1) & (size("r", "window_toks") <= 1)
    window = F.when(F.col("l_window_toks") == F.col("r_window_toks"), size("l", "window_toks")).when(alone, 0).otherwise(both("window_toks"))
    out = once(pairs, {"_toks": both("toks")})
    out = once(out, {"overlap": part("theme", "toks", "_toks"), "n_shared": part("topics", "toks", "_toks"), "_window_toks": window})
    out = once(out, {"_title_theme": part("title_theme", "theme", "overlap")})
    alike = lambda shared, k: F.when(F.col(shared) > 0, F.col(shared) / (F.size(f"l_{k}") + F.size(f"r_{k}") - F.col(shared))).otherwise(0.0)
    out = once(out, {"j_theme": alike("overlap", "theme"), "j_all": alike("_toks", "toks"), "j_title": alike("_title_theme", "title_theme"), "j_window": alike("_window_toks", "window_toks"), "same_title": F.col("l_title_theme") == F.col("r_title_theme")}).drop("_toks", "_title_theme", "_window_toks")
    topical = F.least(0.22 * F.col("n_shared"), F.lit(0.88))
    enough = (F.col("n_shared") >= 2) & ((F.col("j_theme") >= 0.2) | (F.col("overlap") >= 3))
    out = once(out, {"semantic": F.greatest("j_all", F.round(0.95 * F.col("j_theme"), 4), topical, F.when(enough, 0.52).otherwise(0.0)), "title_sim": F.greatest("j_title", "j_theme")})
    near = F.when((F.col("n_shared") >= 1) & (F.col("j_theme") >= 0.35), 0.55).otherwise(0.0)
    out = once(out, {"resolution": F.greatest(F.col("j_window"), 0.65 * F.col("semantic"), 0.8 * F.col("title_sim"), near)})
    equal = ((F.col("semantic") >= 0.62) & (F.col("resolution") >= 0.55)) | F.col("same_title") | (F.col("title_sim") >= 0.72)
    equal = equal | ((F.col("n_shared") >= 2) & ((F.col("j_theme") >= 0.28) | (F.col("overlap") >= 3) | (F.col("resolution") >= 0.45)))
    drivers = (F.col("l_drivers") + F.col("r_drivers") > 0) & (F.col("l_assets") + F.col("r_assets") > 0)
    kind = F.when(equal, "logical_equivalent").when(drivers & ((F.col("j_theme") >= 0.18) | (F.col("semantic") >= 0.24)), "shared_driver").otherwise("narrative_spillover")
    return once(out, {"pair_type": kind})


def _strength(p: str) -> Column:
    return 0.18 * F.col(f"{p}_drivers") + 0.05 * F.col(f"{p}_assets")


def _worded(left_leads: Column) -> Column:
    """causal of pairs that aren't equivalent."""
    lead = F.when(left_leads, _strength("l")).otherwise(_strength("r"))
    other = F.when(left_leads, F.col("r_assets")).otherwise(F.col("l_assets"))
    worded = F.least(0.42 + lead + 0.08 * other, F.lit(0.95))
    thin = (F.col("pair_type") == "narrative_spillover") & (F.col("j_theme") < 0.15) & (F.col("n_shared") == 0)
    return F.when(thin, F.least(worded, F.lit(0.35))).otherwise(worded)


def _most_causal() -> Column:
    """The most that causal can be whatever the liquidity of a pair's markets."""
    return F.when(F.col("pair_type") == "logical_equivalent", 0.78).otherwise(_worded(_strength("l") >= _strength("r")))


def pair_direction(pairs: DataFrame) -> DataFrame:
    """left_leads and causal of pairs: by liquidity where equivalent, else by driver and asset words."""
    left = F.when(F.col("l_liquidity") != 0, F.col("l_liquidity")).otherwise(F.col("l_volume"))
    right = F.when(F.col("r_open_interest") != 0, F.col("r_open_interest")).otherwise(F.col("r_volume"))
    same = F.col("pair_type") == "logical_equivalent"
    out = pairs.withColumn("left_leads", F.when(same, left >= right).otherwise(_strength("l") >= _strength("r")))
    liquid = 0.58 + F.least(F.abs(left - right) / 100000, F.lit(0.2))
    liquid = F.when((F.col("n_shared") >= 2) & (F.col("j_theme") >= 0.35), F.greatest(liquid, F.lit(0.66))).otherwise(liquid)
    return once(out, {"causal": F.when(same, liquid).otherwise(_worded(F.col("left_leads")))})


def _weighted(causal: Column, stability: Column) -> Column:
    kind, (*others, last) = F.col("pair_type"), PAIR_WEIGHTS.items()
    weight = F.lit(last[1])
    for name, x in others:
        weight = F.when(kind == name, x).otherwise(weight)
    return (0.35 * F.col("semantic") + 0.30 * causal + 0.20 * F.col("resolution") + 0.15 * stability) * weight


def pair_composite(pairs: DataFrame, min_score: float = 0.38) -> DataFrame:
    """composite, eligibility and expected latency; pairs under min_score go. stability and ready may be columns of pairs."""
    if "stability" not in pairs.columns:
        pairs = pairs.withColumns({"stability": F.lit(0.0), "ready": F.lit(False)})
    out = once(pairs, {"composite": _weighted(F.col("causal"), F.col("stability"))}).where(F.col("composite") >= min_score)
    fit = (F.col("composite") >= 0.58) & (F.col("resolution") >= 0.35) & (F.col("causal") >= 0.5) & F.col("ready")
    return out.withColumns({"is_trade_eligible": fit, "expected_latency_seconds": F.when(F.col("pair_type") == "logical_equivalent", 45).otherwise(120)})


def score_pairs(pairs: DataFrame, stability: DataFrame | None = None, min_score: float = 0.38) -> DataFrame:
    """All scores of candidate pairs, with the columns stability (0 to 1) and ready of pairs, if they have them, or those joined from stability.

    Pairs that could not reach min_score even with full stability are dropped before that join. Pairs that have their similarity
    already (similar_pairs) are scored by it.
    """
    out = pair_direction(pairs if "pair_type" in pairs.columns else pair_similarity(pairs))
    if stability is not None:
        out = pair_composite(out.withColumns({"stability": F.lit(1.0), "ready": F.lit(False)}), min_score).drop("stability", "ready", "composite", "is_trade_eligible")
        keys = ["l_venue", "l_market_id", "r_venue", "r_market_id"]
        out = out.join(stability.select(*keys, F.col("score").alias("stability"), (F.col("readiness_status") == "ready").alias("ready")), keys, "left").na.fill({"stability": 0.0, "ready": False})
    return pair_composite(out, min_score)


def top_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    return pairs.orderBy(F.desc("composite"), F.desc("semantic"), F.desc("resolution"), "l_market_id", "r_market_id").limit(k)


def coverage_status(pairs: DataFrame, left: DataFrame, right: DataFrame, min_score: float = 0.38) -> DataFrame:
    """One row: what keeps the venues from live pairs, with counts, the best pair's score, the topics both share, and the nearest miss where no pair reaches min_score.

    pairs may hold pairs below min_score (score_pairs with a lower one): they count for the near miss alone.
    """
    n = lambda df, name: df.agg(F.count("*").alias(name))
    good = F.col("composite") >= min_score
    miss = F.max_by(F.concat_ws(" / ", F.col("l_market_id").cast("string"), F.col("r_market_id").cast("string")), F.struct(F.round("composite", 9), -F.col("l_market_id"), -F.col("r_market_id")))
    p = pairs.agg(F.count_if(good).alias("pairs"), F.count_if(good & F.col("is_trade_eligible")).alias("eligible"), F.max(F.when(good, F.col("composite"))).alias("best"), F.when(F.count_if(good) == 0, miss).alias("near_miss"))
    topics = shared_topics(left, right, "topics").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("t"), "token"))), lambda x: x["token"]).alias("shared_topics"))  # eight rows
    row = n(left, "left_markets").crossJoin(n(right, "right_markets")).crossJoin(p).crossJoin(topics)  # one row each
    status = F.when((F.col("left_markets") == 0) | (F.col("right_markets") == 0), "needs_sync").when(F.col("eligible") > 0, "candidate_pairs_live").when(F.col("pairs") > 0, "watch_only").otherwise("insufficient_overlap")
    return row.withColumn("status", status)


def catalog_priority(df: DataFrame, venue: str, reference: DataFrame | None = None) -> DataFrame:
    """priority of catalog rows (with_tokens). First venue: size and theme; second: overlap with tokens of reference too."""
    size = lambda *cols: F.log1p(sum((F.col(c) for c in cols[1:]), F.col(cols[0])))
    if venue == "first":
        score = size("volume", "liquidity") + 0.15 * F.least(F.size("theme"), F.lit(10)) + F.when(driver_hits(F.col("toks")) > 0, 1.0).otherwise(0.0) + F.when(asset_hits(F.col("toks")) > 0, 0.5).otherwise(0.0)
        return df.withColumn("priority", score)
    keyed = lambda arr, name: df.select("venue", "market_id", F.explode(arr).alias("token")).join(reference.select(F.explode(arr).alias("token")).distinct(), "token").groupBy("venue", "market_id").agg(F.count("*").alias(name))
    out = df.join(keyed("theme", "_t"), ["venue", "market_id"], "left").join(keyed("topics", "_o"), ["venue", "market_id"], "left").na.fill(0, ["_t", "_o"])
    out = out.withColumn("overlap", F.col("_t") + 8 * F.col("_o"))
    worth = F.log1p(F.col("volume") + F.col("open_interest") + 100 * F.col("liquidity"))
    priced = F.when(F.col("last_price") > 0, 1.0).otherwise(0.0)
    granular = F.when(F.col("title").contains(" - ") | F.col("title").contains(": "), 0.75).otherwise(0.0)
    return out.withColumn("priority", 4 * F.col("overlap") + worth + priced + granular + F.when(F.col("overlap") > 0, 3.0).otherwise(0.0)).drop("_t", "_o")


def cap_per_group(df: DataFrame, group: str, priority: str, cap: int = 2, limit: int = 40, tie: str = "market_id", only: str | None = None) -> DataFrame:
    """The limit first rows by priority, at most cap of a group, of rows where only is positive; then others by priority where room is left."""
    fit = F.col(only) > 0 if only else F.lit(True)
    rank = F.row_number().over(Window.partitionBy(group, "_fit").orderBy(F.desc(priority), tie))
    return df.withColumn("_fit", fit).withColumn("_late", (~F.col("_fit") | (rank > cap)).cast("int")).drop("_fit").orderBy("_late", F.desc(priority), tie).limit(limit).drop("_late")


def best_per(df: DataFrame, key: list[str], priority: str, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(priority), tie))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


# ---- signals and trades -------------------------------------------------------------------------------------------


def scan_signals(pairs: DataFrame, ticks: DataFrame, books: DataFrame | None = None, n: int = 8) -> DataFrame:
    """The signal of each pair from its n newest ticks a side; pairs with under 3 leader or 2 follower ticks give none."""
    newest = last_n_ticks(ticks, n)
    of = F.struct("rank", "ts_us", "tick_id", "last_price")
    lead = pair_series(pairs, newest, "leader").groupBy("pair_id").agg(F.array_sort(F.collect_list(of)).alias("ls"))  # n ticks at most
    latest = attach_depth(pair_series(pairs, newest.where("rank <= 2"), "follower"), books)
    quote = F.struct("rank", "ts_us", "tick_id", "last_price", "yes_bid", "yes_ask", "no_bid", "no_ask", "depth")
    follow = latest.groupBy("pair_id").agg(F.array_sort(F.collect_list(quote)).alias("fs"))
    x = pairs.join(lead, "pair_id").join(follow, "pair_id").where((F.size("ls") >= 3) & (F.size("fs") >= 2))
    changes = F.transform(F.sequence(F.lit(1), F.size("ls") - 2), lambda i: F.abs(F.get("ls", i)["last_price"] - F.get("ls", i + 1)["last_price"]))
    f0, l0 = F.get("fs", F.lit(0)), F.get("ls", F.lit(0))
    x = x.withColumns({
        "l_move": l0["last_price"] - F.get("ls", F.lit(1))["last_price"], "f_move": f0["last_price"] - F.get("fs", F.lit(1))["last_price"],
        "noise": F.aggregate(changes, F.lit(0.0), lambda s, c: s + c) / F.size(changes), "f": f0, "leader_tick": l0["tick_id"], "latency_ms": F.greatest(F.floor((f0["ts_us"] - l0["ts_us"]) / 1000), F.lit(0)),
    })
    valid = (F.col("f.yes_bid") > 0) & (F.col("f.yes_ask") > 0) & (F.col("f.yes_ask") >= F.col("f.yes_bid"))
    x = x.withColumns({"gap": F.col("l_move") - F.col("f_move"), "threshold": F.greatest(F.lit(0.025), F.col("noise") * 2.2), "liquidity": F.least(F.col("f.depth") / 1000, F.lit(1.0)), "spread": F.when(valid, F.col("f.yes_ask") - F.col("f.yes_bid")).otherwise(0.03)})
    x = x.withColumn("cost", F.round(F.col("spread") + 0.01 + F.greatest(F.lit(0.0), 0.08 - F.col("liquidity") * 0.05), 4))
    x = x.withColumn("edge", F.round(F.abs("gap") - F.col("cost") - F.least(F.col("latency_ms") / 1000, F.lit(5.0)) * 0.002, 4))
    positive = lambda c: F.when(F.col(c) < 0, -1).otherwise(1)
    repriced = (F.abs("f_move") >= F.abs("l_move") * 0.8) & (positive("f_move") == positive("l_move"))
    reason = (
        F.when(F.abs("l_move") < F.col("threshold"), "leader_move_below_threshold").when(repriced, "follower_already_repriced").when(F.col("liquidity") < 0.08, "insufficient_liquidity")
        .when((F.col("causal") < 0.5) & (F.col("pair_type") == "narrative_spillover"), "thematic_link_only").when(F.col("edge") <= 0, "edge_below_cost").otherwise("")
    )
    x = x.withColumn("no_trade_reason", reason)
    return x.select(
        "pair_id", "pair_type", "follower_venue", "follower_id", "leader_tick", F.col("f.tick_id").alias("follower_tick"), F.when(F.col("no_trade_reason") == "", "candidate").otherwise("no_trade").alias("status"),
        F.when(F.col("gap") > 0, "buy_yes").otherwise("buy_no").alias("direction"), "l_move", "gap", "edge", "cost", "latency_ms", "liquidity", "no_trade_reason", F.col("f").alias("quote"),
    )


def paper_trade(signals: DataFrame, ticks: DataFrame, trades: DataFrame | None = None, horizon_s: int = 180, newest: int | None = 50) -> DataFrame:
    """The ledger of trades opened on candidate signals (newest first, newest of them) without one yet, closed where the horizon has passed."""
    fresh = signals.where("status = 'candidate'")
    if trades is not None:
        fresh = not_yet(fresh, trades, ["pair_id", "leader_tick", "follower_tick"])
    if newest:
        fresh = fresh.orderBy(F.desc("quote.ts_us"), F.desc("pair_id")).limit(newest)
    buy = F.col("direction") == "buy_yes"
    price = lambda yes, no: F.when(buy, yes).otherwise(no)
    some = lambda a, b: F.when(a != 0, a).otherwise(b)
    entry = price(some(F.col("quote.yes_ask"), F.col("quote.last_price")), some(F.col("quote.no_ask"), 1 - F.col("quote.last_price")))
    opened = fresh.select("pair_id", "pair_type", "follower_venue", "follower_id", "leader_tick", "follower_tick", "direction", entry.alias("entry"), (F.col("cost") * 0.35).alias("fee"), (F.col("cost") * 0.65).alias("slippage"), "edge", "latency_ms", F.col("quote.ts_us").alias("opened_us"))
    last = latest_after(opened, ticks).select("pair_id", "x")
    out = opened.join(last, "pair_id", "left")
    done = F.coalesce(F.col("x.ts_us") >= F.col("opened_us") + horizon_s * 1_000_000, F.lit(False))
    out = out.withColumn("exit", F.when(done, price(F.col("x.yes_bid"), some(F.col("x.no_bid"), 1 - F.col("x.last_price")))))
    own = price(F.col("x.last_price"), 1 - F.col("x.last_price"))
    return out.select(
        "pair_id", "pair_type", "direction", "leader_tick", "follower_tick", F.when(done, "closed").otherwise("open").alias("status"), "entry", "exit", (F.col("exit") - F.col("entry")).alias("gross"),
        (F.col("exit") - F.col("entry") - F.col("fee") - F.col("slippage")).alias("net"), F.when(done, F.abs(own - F.col("entry"))).alias("adverse"), "edge", "latency_ms", F.when(done, F.floor((F.col("x.ts_us") - F.col("opened_us")) / 1_000_000)).alias("held_s"), "opened_us",
    )


def leadlag_report(trades: DataFrame, signals: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: counts of pairs, signals and trades, and over closed trades profit, hit rate, means and a count for each pair type.

    Means are of closed trades: edge, latency, seconds to exit, adverse excursion, net result. precision_vs_no_trade is the
    share of signals that are candidates.
    """
    closed = F.col("status") == "closed"
    mean = lambda x, d: F.round(F.coalesce(F.avg(F.when(closed, x)), F.lit(0.0)), d)
    total = lambda c: F.round(F.coalesce(F.sum(F.when(closed, F.col(c))), F.lit(0.0)), 4)
    t = trades.agg(
        F.count("*").alias("trade_count"), F.count_if(closed).alias("closed_trades"), total("gross").alias("gross_pnl"), total("net").alias("net_pnl"), mean((F.col("net") > 0).cast("double"), 4).alias("hit_rate"), mean(F.col("edge"), 4).alias("avg_edge"),
        mean(F.col("latency_ms"), 2).alias("avg_latency_ms"), mean(F.col("held_s"), 2).alias("avg_time_to_decay_seconds"), mean(F.col("adverse"), 4).alias("avg_adverse_excursion"), mean(F.col("net"), 4).alias("slippage_adjusted_return"),
    )
    kinds = trades.where(closed).groupBy("pair_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair_type", "n")))).alias("pair_type_breakdown"))  # a row for each type
    s = signals.agg(F.count("*").alias("signal_count"), F.count_if(F.col("status") == "candidate").alias("candidate_count"))
    out = t.crossJoin(s).crossJoin(kinds).crossJoin(pairs.agg(F.count("*").alias("pair_count")))  # one row each
    return out.withColumn("precision_vs_no_trade", F.when(F.col("signal_count") > 0, F.round(F.col("candidate_count") / F.col("signal_count"), 4)).otherwise(0.0))


def trade_totals(trades: DataFrame) -> DataFrame:
    closed = F.col("status") == "closed"
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return trades.agg(F.count("*").alias("opened"), F.count_if(closed).alias("closed"), zero(F.sum("gross")).alias("gross_pnl"), zero(F.sum("net")).alias("net_pnl"), zero(F.avg("adverse")).alias("avg_adverse"))


def breakdown(df: DataFrame, col: str) -> DataFrame:
    """Values of a column and their counts, the most common first."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def monitor_lists(pairs: DataFrame, signals: DataFrame, trades: DataFrame, backtests: DataFrame | None = None) -> dict[str, DataFrame]:
    """The newest or best rows a monitor shows: 24 pairs, 20 signals, 20 trades and 3 backtests (experiments)."""
    best = [F.desc("composite"), F.col("pair_id")] if "composite" in pairs.columns else [F.col("pair_id")]
    out = {"pairs": pairs.orderBy(*best).limit(24), "signals": signals.orderBy(F.desc("quote.ts_us"), "pair_id").limit(20), "trades": trades.orderBy(F.desc("opened_us"), "pair_id").limit(20)}
    if backtests is not None:
        out["backtests"] = backtests.where("task = 'leadlag'").orderBy(F.desc("created_us"), "title").limit(3)
    return out


def pair_detail(pairs: DataFrame, signals: DataFrame, trades: DataFrame, pair_id: int, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A pair with its k newest signals and trades."""
    one = lambda df: df.where(F.col("pair_id") == pair_id)
    return one(pairs), one(signals).orderBy(F.desc("quote.ts_us"), "leader_tick").limit(k), one(trades).orderBy(F.desc("opened_us"), "leader_tick").limit(k)
