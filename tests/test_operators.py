"""Fixtures with known answers for the analytics operators."""

import json

import pytest
from pyspark.sql import functions as F

from marketlens.functions import normalize as nz
from marketlens.functions import tokens as tk
from marketlens.operators import forecast as fc
from marketlens.operators import graphs as gr
from marketlens.operators import leadlag as ll
from marketlens.operators import review as rv
from marketlens.operators import traces as tc
from marketlens.sources import files as fl
from marketlens.streaming import books as bk


def series(spark, leader, follower, step=60, lag=15):
    rows = [("a", 1, p, i * step) for i, p in enumerate(leader)] + [("b", 2, p, i * step + lag) for i, p in enumerate(follower)]
    df = spark.createDataFrame([(k, v, m, p, int(t * 1_000_000)) for k, (v, m, p, t) in enumerate(rows)], "tick_id long, venue string, market_id long, last_price double, ts_us long")
    return quoted(df)


def quoted(df):
    return df.withColumns({"yes_bid": F.col("last_price") - 0.01, "yes_ask": F.col("last_price") + 0.01, "no_bid": 1 - (F.col("last_price") + 0.01), "no_ask": 1 - (F.col("last_price") - 0.01), "bid_size": F.lit(800.0), "ask_size": F.lit(800.0)})


@pytest.fixture
def pair(spark):
    return spark.createDataFrame([(1, "a", 1, "b", 2, "logical_equivalent", 0.6, 45)], "pair_id long, leader_venue string, leader_id long, follower_venue string, follower_id long, pair_type string, causal double, expected_latency_seconds int")


def test_stability_ready(spark, pair):
    s = ll.stability(pair, series(spark, [0.32, 0.38, 0.44, 0.50, 0.56, 0.61], [0.31, 0.35, 0.41, 0.47, 0.53, 0.58], lag=20)).first()
    assert s.readiness_status == "ready" and s["first"] >= 0.8 and s.moves >= 4 and s.aligned == 6
    s = ll.stability(pair, series(spark, [0.3, 0.4], [0.3, 0.4])).first()
    assert s.readiness_status == "needs_history" and s.score == 0


def test_repriced_is_no_trade(spark, pair):
    rows = [("a", 1, 0.42, -20), ("a", 1, 0.44, -10), ("a", 1, 0.58, 0), ("b", 2, 0.40, -20), ("b", 2, 0.45, -10), ("b", 2, 0.57, 0.8)]
    t = quoted(spark.createDataFrame([(k, v, m, p, int(s * 1e6)) for k, (v, m, p, s) in enumerate(rows)], "tick_id long, venue string, market_id long, last_price double, ts_us long"))
    r = ll.scan_signals(pair, t).first()
    assert (r.status, r.no_trade_reason, r.latency_ms) == ("no_trade", "follower_already_repriced", 800)


def test_positive_trade(spark, pair):
    rows = [("a", 1, 0.32, -30), ("a", 1, 0.35, -20), ("a", 1, 0.52, 0), ("b", 2, 0.34, -30), ("b", 2, 0.35, -20), ("b", 2, 0.36, 1)]
    make = lambda rows: quoted(spark.createDataFrame([(k, v, m, p, int(s * 1e6)) for k, (v, m, p, s) in enumerate(rows)], "tick_id long, venue string, market_id long, last_price double, ts_us long"))
    signals = ll.scan_signals(pair, make(rows))
    assert signals.first().status == "candidate"
    opened = ll.trade_totals(ll.paper_trade(signals, make(rows))).first()
    assert (opened.opened, opened.closed) == (1, 0)
    r = ll.trade_totals(ll.paper_trade(signals, make([*rows, ("b", 2, 0.48, 240)]))).first()
    assert (r.opened, r.closed) == (1, 1) and r.net_pnl > 0
    trade = ll.paper_trade(signals, make(rows))
    assert ll.paper_trade(signals, make(rows), trades=trade).count() == 0


def test_asof_equals_all_pairs(spark):
    import random

    random.seed(4)
    rows = lambda n, base: [(1, base + k, random.random(), random.randrange(0, 500) * 1_000_000) for k in range(n)]
    a, b = rows(80, 0), rows(60, 1000)
    ddl = "pair_id int, tick_id int, last_price double, ts_us long"
    got = {r.l_id: r.f_id for r in ll.nearest_asof(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), "pair_id", 7).collect()}
    for _, i, _, t in a:
        best = min(b, key=lambda f: (abs(f[3] - t), f[3], -f[1] if f[3] <= t else f[1]))
        assert got.get(i) == (best[1] if abs(best[3] - t) <= 7_000_000 else None)


def test_descent_like_one_task(spark):
    """Gradients summed over all rows give the models that one task does; a group of one class has a prior alone."""
    import random

    rng = random.Random(2)
    rows = [(g, k, rng.random(), rng.random() * 9, 5.0, int(rng.random() < 0.3 + 0.1 * g) if g < 3 else 1) for g in range(4) for k in range(40)]
    df = spark.createDataFrame(rows, "block int, snapshot_id int, a double, b double, c double, target int").repartition(3)
    near = lambda x, y: x is None and y is None or abs(x - y) < 1e-9
    flat = lambda r: [r.prior, r.bias, *(r.weights or []), *(r.means or []), *(r.scales or [])]
    one, many = ({r.block: flat(r) for r in fc.fit_logistic(df, "block", ["a", "b", "c"], 12, held).collect()} for held in (1000, 0))
    assert set(one) == {0, 1, 2, 3} and all(len(one[g]) == len(many[g]) and all(map(near, one[g], many[g])) for g in one) and one[3][1] is None
    x = df.withColumns({f: F.col("a") * (i + 1) if i % 2 else F.col("b") for i, f in enumerate(fc.FEATURES)}).withColumn("ts_us", F.col("block"))
    runs = [{(r.block, r.snapshot_id): r.model_probability for r in fc.forecast_backtest(x, held=held, epochs=7).collect()} for held in (1000, 0)]
    assert len(runs[0]) == 120 and set(runs[0]) == set(runs[1]) and all(near(runs[0][k], runs[1][k]) for k in runs[0])


def test_asof_of_a_hot_pair(spark):
    """A pair with nine tenths of all ticks, cut into slices: the same rows, and no partition key holds many."""
    import random

    rng = random.Random(8)
    side = lambda n, base: [(rng.choice([1] * 9 + [2]), base + k, rng.random(), rng.choice([rng.randrange(0, 900), rng.randrange(400, 410)]) * 1_000_000, float(rng.choice([3, 40]))) for k in range(n)]
    ddl = "pair_id int, tick_id int, last_price double, ts_us long, tol double"
    a, b = spark.createDataFrame(side(700, 0), ddl), spark.createDataFrame(side(300, 5000), ddl)
    rows = lambda most, tol: sorted(map(tuple, ll.nearest_asof(a, b.drop("tol"), "pair_id", tol, most).collect()))
    for tol in (7.0, "tol"):
        assert rows(50, tol) == rows(10**9, tol)
    both = a.select("pair_id", "ts_us", F.lit(1).alias("kind"), "tick_id", F.struct("ts_us", "tick_id", "last_price").alias("tick"), "tol")
    assert ll._sliced(both, "pair_id", 50).groupBy("pair_id", "slice").count().agg(F.max("count")).first()[0] < 150


def markets(spark, rows):
    df = spark.createDataFrame([(v, i, t, "", g, "2026-03-18", 120000.0, 80000.0, 60000.0, True) for v, i, t, g in rows], "venue string, market_id long, title string, resolution_text string, tags array<string>, resolution_window string, volume double, liquidity double, open_interest double, is_active boolean")
    return ll.with_tokens(df)


def test_pair_cases(spark):
    m = markets(spark, [
        ("a", 1, "Fed decision in March", ["Fed", "Rates"]), ("b", 2, "Fed decision in March", ["Fed", "Rates"]), ("b", 3, "Bitcoin above 120k by June", ["Crypto"]),
        ("a", 4, "Will Tim Walz win the 2028 US Presidential Election?", ["Politics", "Election", "Tim Walz"]), ("b", 5, "Who will win the next presidential election? - Tim Walz", ["Politics", "Election", "Tim Walz"]),
        ("a", 6, "Barron Trump pardon", ["Politics"]), ("b", 7, "Bitcoin $150,000", ["Crypto"]), ("a", 8, "", []), ("b", 9, "", []),
    ])
    left, right = m.where("venue = 'a'"), m.where("venue = 'b'")
    s = {(r.l_market_id, r.r_market_id): r for r in ll.score_pairs(ll.candidate_pairs(left, right)).collect()}
    assert s[1, 2].pair_type == "logical_equivalent" and s[4, 5].pair_type == "logical_equivalent"
    assert s[4, 5].semantic >= 0.5 and s[4, 5].resolution >= 0.55 and not s[4, 5].is_trade_eligible
    assert (6, 7) not in s
    every = {(r.l_market_id, r.r_market_id) for r in ll.score_pairs(ll.candidate_pairs(left, right, "cross")).collect()}
    # Full stability is the bound under which blocking loses nothing.
    full = spark.createDataFrame([(a, x, b, y, 1.0, "ready") for a, x, b, y in [("a", i, "b", j) for i in (1, 4, 6, 8) for j in (2, 3, 5, 7, 9)]], "l_venue string, l_market_id long, r_venue string, r_market_id long, score double, readiness_status string")
    keys = lambda mode: {(r.l_market_id, r.r_market_id) for r in ll.score_pairs(ll.candidate_pairs(left, right, mode), full).collect()}
    assert set(s) == every and keys("blocked") == keys("cross")


def test_forecast_fixture(spark):
    rows = []
    for i in range(12):
        p, rel, ev = round(0.18 + 0.055 * i, 3), i % 4, (i + 1) % 3
        rows.append((i, f"e{i}", i * 86_400_000_000, p, 1000.0 + 250 * i, 700.0 + 150 * i, 400.0 + 90 * i, rel, ev, 1 if p + 0.05 * rel + 0.04 * ev >= 0.56 else 0, i))
    x = fc.snapshot_features(spark.createDataFrame(rows, "snapshot_id long, event_slug string, ts_us long, p double, volume double, liquidity double, open_interest double, related_market_count int, evidence_count int, target int, block int"))
    exact = fc.forecast_backtest(x, min_train=4, mode="exact")
    assert exact.count() == 8
    blocks = {r.snapshot_id: r.model_probability for r in fc.forecast_backtest(x, min_train=4).collect()}
    assert all(abs(blocks[r.snapshot_id] - r.model_probability) < 1e-9 for r in exact.collect())
    assert {r.prediction for r in fc.forecast_metrics(exact, ["p", "model_probability"]).collect()} == {"p", "model_probability"}
    assert fc.forecast_backtest(x, min_train=4, mode="ml").count() == 8


def test_labels(spark):
    m = "array<struct<outcomes:array<string>,outcome_prices:array<double>>>"
    yes, mid = [(["Yes", "No"], [0.995, 0.005])], [(["Yes", "No"], [0.5, 0.5])]
    s = spark.createDataFrame([(1, "x", 1, "open", mid), (2, "x", 2, "closed", yes), (3, "y", 1, "closed", mid)], f"snapshot_id long, event_slug string, ts_us long, status string, markets {m}")
    out = {r.snapshot_id: r.resolved_outcome for r in fc.label_families(s).collect()}
    assert out == {1: "Yes", 2: "Yes"}
    labels = spark.createDataFrame([(1, "x", "No", 1.0, 5)], "snapshot_id long, event_slug string, resolved_outcome string, resolved_probability double, created_us long")
    rows, report = fc.backfill_labels(s, labels)
    assert {r.snapshot_id: r.resolved_outcome for r in rows.collect()} == {2: "No"} and report.first().unresolved == 1


def test_upsert_counts(spark):
    ddl = "event_slug string, ts_us long, snapshot_id long, p double"
    target = spark.createDataFrame([("x", 1, 1, 0.5), ("y", 1, 2, 0.6)], ddl)
    batch = spark.createDataFrame([("x", 1, 1, 0.7), ("z", 1, 3, 0.1), ("y", 1, 2, 0.6)], ddl)
    rows, report = fc.upsert_snapshots(target, batch)
    r = report.first()
    assert (r.created, r.updated, r.skipped) == (1, 1, 1)
    again = fc.upsert_snapshots(rows, batch)[1].first()
    assert (again.created, again.updated, again.skipped) == (0, 0, 3)


def test_consensus_states(spark):
    j = spark.createDataFrame(
        [(1, 1, "A  b", "A b", "core", "Alice Example", 1, 1), (2, 1, "a b", "A b", "reject", "bob", 1, 2), (3, 1, "c", "C", "watch", "alice", 2, 1), (4, 1, "c", "C", "watch", "bob", 2, 2), (5, 1, "d", "D", "core", "alice", 3, 1), (6, 1, "d", "D", "watch", "alice", 3, 2), (7, 1, "e", "", "core", "x", 3, 2), (8, 1, "f", "F", "maybe", "x", 3, 2)],
        "judgment_id long, run_id long, candidate_key string, candidate_title string, usefulness_label string, reviewer string, candidate_rank int, updated_us long",
    )
    ok, bad = rv.validate_judgments(j)
    assert bad.count() == 2
    c = {r.candidate_key: r for r in rv.consensus(ok).collect()}
    assert c["a b"].state == "contested" and c["a b"].label == "core" and c["c"].state == "agreed" and c["d"].state == "needs_second_review" and c["d"].label == "watch"


def test_trust_fixture(spark):
    nodes = spark.createDataFrame([(1, "Entity", "http://s", [], []), (2, "Hypothesis", "", [], [])], "run_id int, type string, source_url string, snippets array<string>, metadata array<string>")
    edges = spark.createDataFrame([(1, "because"), (2, " ")], "run_id int, explanation string")
    reviews = spark.createDataFrame([(1, True, 0), (2, False, 1)], "run_id int, approved boolean, issue_count int")
    traces = spark.createDataFrame([(1, "retriever", "completed", 2, 5, 0, 0.0), (2, "retriever", "completed", 0, 5, 0, 0.0), (2, "graph_editor", "skipped", 0, 0, 0, 0.0)], "run_id int, stage string, status string, citations int, latency_ms int, tokens int, cost_usd double")
    t = {r.run_id: r.trust for r in gr.trust_examples(nodes, edges, reviews, traces).collect()}
    assert abs(t[1] - 1.0) < 1e-9 and abs(t[2] - 0.1 * (1 - 1 / 3)) < 1e-9


def test_instrumentation_fixture(spark):
    rows = [(k, 1, s, "completed", 5 if k else 0, 10 if k in (2, 4) else 0, 0.1 if k in (2, 4) else 0.0, 0 if k == 3 else 1, k in (2, 4), k) for k, s in enumerate(tc.STAGES)]
    rows.append((9, 2, "manual_review", "failed", 7, 10, 0.1, 1, True, 9))
    t = spark.createDataFrame(rows, "trace_id long, run_id long, stage string, status string, latency_ms int, tokens int, cost_usd double, citations int, llm boolean, created_us long")
    r = tc.instrumentation_report(t, spark.createDataFrame([(1,), (2,)], "run_id long")).first()
    assert (r.trace_count, r.run_coverage_rate, r.required_stage_coverage_rate, r.llm_count) == (6, 1.0, 0.5, 3)
    assert abs(r.citation_coverage_rate - 5 / 6) < 1e-9 and abs(r.latency_coverage_rate - 5 / 6) < 1e-9 and r.token_coverage_rate == 1.0 and r.cost_coverage_rate == 1.0


def test_backfill_twice(spark):
    runs = spark.createDataFrame([(1, 5, {"planner": "completed"})], "run_id long, created_us long, log map<string,string>")
    none = spark.createDataFrame([], "run_id long, stage string")
    first = tc.backfill_traces(runs, none)
    assert first.count() == 5 and tc.backfill_traces(runs, first).count() == 0


def test_rebuilt_twice(spark):
    """Records that were rebuilt are traces from then on; overwriting gives all five stages; odd payloads count as empty."""
    runs = spark.createDataFrame([(1, "u", "seed", None, None), (2, "u", "seed", "[1]", "x"), (3, None, None, '{"run": {"agent_pipeline": {"stage": "planner"}}, "graph": 7}', "{}"), (4, "u", "seed", '{"run": {"agent_pipeline": [{"stage": "critic", "latency_ms": "x"}]}, "context": {"related_candidates": [{"snapshot": {"canonical_url": "v"}}, {"snapshot": {"canonical_url": "", "source_url": "w"}}]}}', None)], "run_id long, source_url string, mode string, payload string, workflow_log string")
    none = spark.createDataFrame([], "trace_id long, run_id long, stage string, status string, latency_ms long, token_input long, token_output long, cost_usd double, citations array<string>")
    first = tc.rebuild_traces(runs, none)
    assert first.count() == 20
    by = {(r.run_id, r.stage): r for r in first.collect()}
    assert by[4, "retriever"].citations == ["u", "v", "w"] and by[4, "critic"].origin == "payload" and by[1, "retriever"].status == "fallback" and by[3, "graph_editor"].status == "skipped"
    have = first.withColumn("trace_id", F.lit(1).cast("long")).select(none.columns)
    assert tc.rebuild_traces(runs, have).count() == 0 and tc.rebuild_traces(runs, have, overwrite=True).count() == 20


def test_normalisers(spark):
    x = spark.createDataFrame([("5.5", 55.0, "1710000000000", " http://a.b/event/x-y/?q=1#f ", '["Yes","No"]', ["Fed", " fed ", "", "Rates"])], "a string, c double, t string, u string, j string, g array<string>")
    r = x.select(nz.to_float(F.col("a")).alias("a"), nz.to_float(F.lit("nan")).alias("n"), nz.cents_or_dollars(F.col("c")).alias("c"), F.unix_seconds(nz.parse_event_time(F.col("t"), F.timestamp_seconds(F.lit(0)))).alias("t"), nz.normalize_url(F.col("u")).alias("u"), nz.url_slug(F.col("u")).alias("s"), nz.url_is_valid(F.trim("u"), "a.b").alias("v"), nz.json_string_list(F.col("j")).alias("j"), nz.json_string_list(F.lit("x")).alias("k"), nz.distinct_ci(F.col("g")).alias("g"), nz.humanize(F.lit("total_cost-usd")).alias("h"), nz.trace_cost(F.lit("claude-opus-4-1"), F.lit(1_000_000), F.lit(0)).alias("p")).first()
    assert (r.a, r.n, r.c, r.t, r.u, r.s, r.v, r.j, r.k, r.g, r.h, r.p) == (5.5, 0.0, 0.55, 1710000000, "http://a.b/event/x-y", "x-y", True, ["Yes", "No"], [], ["Fed", "Rates"], "Total Cost USD", 15.0)
    t = spark.range(1).select(tk.tokens(F.lit("Will the Presidency of BTC be US?")).alias("t"), tk.jaccard(F.array(F.lit("a")), F.array().cast("array<string>")).alias("j")).first()
    assert (sorted(t.t), t.j) == (["bitcoin", "president"], 0.0)


def message(**kw):
    return json.dumps(kw)


def test_book_fold_batch_and_stream(spark, tmp_path):
    lines = [
        message(event_type="book", asset_id="m-y", timestamp="1710000000000", bids=[{"price": ".51", "size": "1200"}], asks=[{"price": ".53", "size": "1100"}]),
        message(event_type="book", asset_id="n-n", timestamp="1710000000000", bids=[{"price": ".47", "size": "800"}], asks=[{"price": ".49", "size": "700"}]),
        "PONG", "", "[" + message(event_type="market_resolved", market="r", winning_asset_id="r-n", timestamp="1710000000000") + "]", message(event_type="price_change", asset_id="m-y", timestamp="1710000001000", best_bid=".52", size="5"), message(event_type="price_change", asset_id="m-y", timestamp="1700000001000", best_bid=".1"),
    ]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("\n".join(lines))
    maps = spark.createDataFrame([("a", m, [f"{m}-y", f"{m}-n"], ["Yes", "No"]) for m in "mnr"], "venue string, market_id string, clob_token_ids array<string>, outcomes array<string>")
    assets = ll.asset_lookup(maps)
    batch = bk.orderbook_ticks(bk.parse_messages(spark.read.text(str(src))), assets)
    by = {(r.market_id, r.ts_us): r for r in batch.collect()}
    first, no, done = by["m", 1710000000000000], by["n", 1710000000000000], by["r", 1710000000000000]
    assert (first.yes_bid, first.yes_ask, first.bid_size, first.ask_size) == (0.51, 0.53, 1200, 1100)
    assert [round(x, 9) for x in (no.yes_bid, no.yes_ask, no.no_bid, no.no_ask)] == [0.51, 0.53, 0.47, 0.49]
    assert (done.status, done.last_price, done.yes_bid, done.no_bid) == ("resolved", 0.0, 0.0, 1.0)
    assert by["m", 1710000001000000].yes_bid == 0.52 or by["m", 1710000001000000].bid_size == 5
    out = bk.orderbook_ticks(bk.read_message_stream(spark, str(src)), assets)
    q = out.writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.market_id, r.ts_us)
    assert sorted(map(tuple, spark.table("folded").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str) and key


def test_dedup_stream(spark, tmp_path):
    rows = [{"tick_id": k, "venue": "a", "market_id": 1, "event_type": "t", "ts_us": 1_710_000_000_000_000, "sequence_id": s, "last_price": p, "yes_bid": 0.1, "yes_ask": 0.2, "bid_size": 1.0, "ask_size": 1.0, "volume": 1.0} for k, (s, p) in enumerate([("dup", 0.5), ("dup", 0.5), ("", 0.5), ("", 0.7), ("x", 0.8)])]
    src = tmp_path / "t"
    src.mkdir()
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    ddl = "tick_id long, venue string, market_id long, event_type string, ts_us long, sequence_id string, last_price double, yes_bid double, yes_ask double, bid_size double, ask_size double, volume double"
    batch = {r.tick_id for r in bk.dedup_ticks(spark.read.schema(ddl).json(str(src))).collect()}
    assert batch == {0, 3, 4}
    q = bk.dedup_ticks(spark.readStream.schema(ddl).json(str(src))).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup").count() == 3


def test_files(spark, tmp_path):
    path = tmp_path / "ticks.jsonl"
    tick = {"venue": "a", "market_id": "m", "exchange_timestamp": "2026-03-18T10:00:00Z", "last_price": ".51", "yes_bid": 50, "bids": [{"price": ".50", "size": "900"}], "asks": [{"price": ".52", "quantity": "870"}]}
    path.write_text(json.dumps(tick) + "\n\n{broken\n")
    r = [x for x in fl.read_ticks_jsonl(spark, str(path)).collect() if x.market_id]
    assert len(r) == 1 and (r[0].event_type, r[0].yes_bid, r[0].total_bid_depth, r[0].total_ask_depth) == ("ticker", 0.5, 900.0, 870.0)
    assert fl.read_examples_jsonl(spark, str(tmp_path / "none")).count() == 0
    ex = spark.createDataFrame([("r", {"a": 1.0}, 1.0, 0.5, True)], "run_id string, features map<string,double>, target double, predicted double, approved boolean")
    fl.append_training_examples(ex, str(tmp_path / "ex"))
    fl.append_training_examples(ex, str(tmp_path / "ex"))
    assert fl.read_examples_jsonl(spark, str(tmp_path / "ex")).count() == 2
    done = fl.export_dataset({"leadlag_pairs": spark.createDataFrame([(1, "x", 0.5, True)], "pair_id long, pair_type string, composite double, is_trade_eligible boolean")}, str(tmp_path / "out"))
    assert done == ["leadlag_pairs"] and fl.register_tables(spark, str(tmp_path / "out")) == done and spark.table("leadlag_pairs").count() == 1
    assert len(fl.EXPORTS) == 17
    full = {n: spark.createDataFrame([], fl.export_schema(n)) for n in fl.EXPORTS}
    assert len(fl.export_dataset(full, str(tmp_path / "all"))) == 17 == len(fl.register_tables(spark, str(tmp_path / "all"), database="whole"))
    assert fl.register_tables(spark, str(tmp_path / "out"), database="partly") == done and spark.table("partly.leadlag_pairs").count() == 1
    described = lambda d, n: [(r.col_name, r.data_type) for r in spark.sql(f"describe {d}.{n}").collect()]
    assert all(described("whole", n) == described("partly", n) for n in fl.EXPORTS) and ("net", "double") in described("partly", "paper_trades")


def test_path_beats_plain_search(spark):
    nodes = spark.createDataFrame([(1, i, f"n{i}", "Event" if i == 0 else "Entity") for i in range(6)], "run_id int, pos int, node_id string, type string")
    edges = [(0, 1, 0.5), (1, 2, 0.9), (2, 3, 0.2), (0, 4, 0.8), (4, 5, 0.3), (5, 2, 0.7), (3, 0, 0.1)]
    e = spark.createDataFrame([(1, k, f"e{k}", f"n{a}", f"n{b}", "related_to", c) for k, (a, b, c) in enumerate(edges)], "run_id int, pos int, edge_id string, source string, target string, type string, confidence double")
    r = gr.strongest_path(nodes, e).first()
    near = {}
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c + 0.04))
        near.setdefault(b, []).append((a, c + 0.04))

    def walk(at, seen, score):
        best = score if len(seen) >= 3 else 0
        return max([best, *(walk(b, [*seen, b], score + c) for b, c in near[at] if b not in seen and len(seen) < 5)])

    assert abs(r.score - walk(0, [0], 0)) < 1e-9
    depth = {x.node_id: x.depth for x in gr.bfs_depth(nodes, e).collect()}
    assert depth == {"n0": 0, "n1": 1, "n2": 2, "n3": 1, "n4": 1, "n5": 2}


def test_rate_flags_slide(spark, tmp_path):
    """21 hits in 4.8 seconds across a border of five seconds are a burst; tiers count their own requests only."""
    rows = [("a", 3.0 + 0.24 * k, "GET", "/about") for k in range(21)] + [("b", 0.5 * k, "GET", "/about") for k in range(21)]
    rows += [("c", 4.0 * k, "POST", "/api/v1/runs/") for k in range(14)] + [("d", 4.0 * k, "GET", "/api/v1/runs/") for k in range(14)]
    log = spark.createDataFrame(rows, "key string, s double, method string, path string").select("key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), bk.request_tier(F.col("method"), F.col("path")).alias("tier"))
    got = sorted((r.key, r.kind, r.hits, r.until is None) for r in bk.rate_flags(log).collect())
    assert got == [("a", "burst", 21, False), ("c", "api_write", 13, True), ("c", "api_write", 14, True)]
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")).withWatermark("ts", "1 second")
    q = bk.rate_flags(stream).writeStream.format("memory").queryName("flags").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert {(r.key, r.kind) for r in spark.table("flags").collect()} <= {("a", "burst"), ("c", "api_write")}


def test_a_repeat_keeps_its_book(spark):
    """Ticks 1 to 3 repeat 0, by sequence id or by values; only 3 has a book, which 0 gets. Tick 4 has one of its own."""
    rows = [(0, "x", 0.5), (1, "x", 0.6), (2, "", 0.5), (3, " ", 0.5), (4, "y", 0.7), (5, "y", 0.7)]
    t = spark.createDataFrame([(k, "a", 1, "t", 7, s, p, 0.1, 0.2, 1.0, 1.0, 1.0) for k, s, p in rows], "tick_id long, venue string, market_id long, event_type string, ts_us long, sequence_id string, last_price double, yes_bid double, yes_ask double, bid_size double, ask_size double, volume double")
    books = spark.createDataFrame([(3, 30.0), (4, 40.0), (5, 50.0)], "tick_id long, total_bid_depth double")
    assert sorted(r.tick_id for r in bk.dedup_ticks(t).collect()) == [0, 4]
    assert sorted(map(tuple, bk.dedup_books(t, books).collect())) == [(0, 30.0), (4, 40.0)]


def test_folds_number_rows_through_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("ts_us"), F.col("id").alias("snapshot_id")).repartition(7)
    got = sorted((r.ord, r.ts_us, r.fold) for r in fc.expanding_folds(df, ["ts_us", "snapshot_id"]).collect())
    want = sorted(k * 7919 % 503 for k in range(500))
    assert got == [(k + 1, t, k + 1 if k >= 8 else None) for k, t in enumerate(want)]


def test_builder_falls_back(spark):
    """An event without candidates, size, rule or names: its category and markets stand in; one with a candidate links it."""
    e = spark.createDataFrame(
        [(1, "s1", "what next", [], None, "Oil", 0.0, 0.0, "", "", "http://e", [("", "m-one"), ("Second?", "")]), (2, "s2", "Iran talks", ["us-iran"], "d", "X", 5.0, 0.0, "now", "https://www.host.org/a", "http://e", [])],
        "run_id long, slug string, title string, tags array<string>, description string, category string, volume double, liquidity double, updated_at string, rule string, source_url string, markets array<struct<question:string,slug:string>>",
    )
    c = spark.createDataFrame([(2, "near", "Near it", 0.8, "why", "http://n")], "run_id long, slug string, title string, score double, rationale string, source_url string")
    nodes = gr.build_nodes(e, c)
    by = {}
    for r in nodes.orderBy("run_id", "pos").collect():
        by.setdefault(r.run_id, []).append((r.node_id, r.label, r.confidence))
    assert [x[0] for x in by[1]] == ["evt_001", "ent_1_oil", "ent_2_market-participants", "mkt_fallback_1_m-one", "mkt_fallback_2_second", "ev_description", "hyp_fallback_narrative"]
    assert [x[0] for x in by[2]] == ["evt_001", "ent_1_iran", "ent_2_us-iran", "mkt_1_near", "ev_description", "ev_market_structure", "ev_timing", "rule_resolution", "hyp_1_near"]
    assert ("rule_resolution", "Resolution source: host.org", 0.96) in by[2] and ("hyp_1_near", "Near it reprices through narrative spillover", 0.75) in by[2]
    edges = {(r.source, r.target, r.type): r.confidence for r in gr.build_edges(nodes).where("run_id = 2").collect()}
    assert edges["ent_1_iran", "mkt_1_near", "affects_directly"] == 0.67 and edges["ev_description", "mkt_1_near", "mentions"] == 0.72 and edges["hyp_1_near", "mkt_1_near", "affects_indirectly"] == 0.72
