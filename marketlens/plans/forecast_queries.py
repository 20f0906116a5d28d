"""Queries of the forecast and review operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import forecast as fc
from ..operators import review as rv
from .adapters import dealt, micros, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


R = lambda c, d=6: F.round(c, d).alias(c)

# ---- snapshots: orders as closing and open snapshots of their customer's event ----


def snapshots(spark, d):
    o = table(spark, d, "orders")
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.countDistinct("l_returnflag").alias("flags"))
    o = o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0, ["lines", "flags"])
    p = ((F.col("o_orderkey") * 7919) % 1000) / 1000.0
    market = F.struct(F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"), F.array(p, 1 - p).alias("outcome_prices"))
    return o.select(F.col("o_orderkey").alias("snapshot_id"), F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("event_slug"), micros("o_orderdate").alias("ts_us"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), p.alias("p"), F.col("o_totalprice").alias("volume"), (F.col("o_totalprice") / 2).alias("liquidity"), F.lit(0.0).alias("open_interest"), F.col("lines").alias("related_market_count"), F.col("flags").alias("evidence_count"), F.array(market).alias("markets"), F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"))


S = """ln as (select l_orderkey, count(*) as lines, count(distinct l_returnflag) as flags from lineitem group by 1),
s as (select o_orderkey as snapshot_id, 'e' || o_custkey as event_slug, epoch_us(o_orderdate) as us, case when o_orderstatus = 'F' then 'closed' else 'open' end as status, ((o_orderkey * 7919) % 1000) / 1000.0::double as p, o_totalprice as volume, coalesce(lines, 0) as lines, coalesce(flags, 0) as flags from orders left join ln on l_orderkey = o_orderkey),
ts as (select *, case when p >= 1 - p then 'Yes' else 'No' end as outcome, greatest(p, 1 - p) as price from s),
dc as (select event_slug, outcome, price from ts where status = 'closed' and price >= 0.99 qualify row_number() over (partition by event_slug order by us desc, snapshot_id desc) = 1)"""


@query("b19_terminal_outcome", f"with {S} select snapshot_id, outcome, price from ts")
def b19(spark, d):
    return snapshots(spark, d).select("snapshot_id", fc.terminal_outcome(F.col("markets")).alias("t")).select("snapshot_id", "t.outcome", "t.price")


@query("b15_yes_probability", f"with {S} select snapshot_id, p from s")
def b15(spark, d):
    return snapshots(spark, d).select("snapshot_id", nz.yes_probability(F.col("outcomes"), F.col("markets"), F.col("p")).alias("p"))


@query("b16_implied_probability", f"with {S} select snapshot_id, p, case when p > 0 then round(p * 100, 1) end as percent from s")
def b16(spark, d):
    s = snapshots(spark, d).select("snapshot_id", nz.event_implied_probability(F.col("markets")).alias("p"))
    return s.withColumn("percent", nz.percent_probability(F.col("p")))


@query("j1_label_families", f"with {S} select snapshot_id, s.event_slug, outcome as resolved_outcome, price as resolved_probability from s join dc using (event_slug)")
def j1(spark, d):
    return fc.label_families(snapshots(spark, d)).drop("source")


def _prior(spark, d):
    """Labels already there: those of every third order of a decided event."""
    labels = fc.label_families(snapshots(spark, d)).where("snapshot_id % 3 = 0")
    return labels.withColumn("created_us", F.col("snapshot_id"))


PRIOR = f"{S}, al as (select snapshot_id, s.event_slug, outcome as resolved_outcome, price as resolved_probability from s join dc using (event_slug)), pl as (select * from al where snapshot_id % 3 = 0)"


@query("j2_propagate_labels", f"with {PRIOR}, nw as (select event_slug, resolved_outcome from pl qualify row_number() over (partition by event_slug order by snapshot_id desc) = 1) select s.snapshot_id, event_slug, nw.resolved_outcome from s join nw using (event_slug) where s.snapshot_id not in (select snapshot_id from pl)")
def j2(spark, d):
    return fc.propagate_labels(snapshots(spark, d), _prior(spark, d)).select("snapshot_id", "event_slug", "resolved_outcome")


@query("j3_backfill_report", f"with {PRIOR}, kn as (select distinct event_slug from pl), b as (select event_slug, case when event_slug in (select event_slug from kn) then 1 when event_slug in (select event_slug from dc) then 2 else 3 end as k from s where snapshot_id not in (select snapshot_id from pl)) select count(distinct event_slug) as slugs, count(*) filter (k = 1) as propagated, count(*) filter (k = 2) as terminal, count(*) filter (k = 3) as unresolved from b")
def j3(spark, d):
    return fc.backfill_labels(snapshots(spark, d), _prior(spark, d))[1]


def _batch(spark, d):
    s = snapshots(spark, d).select("event_slug", "ts_us", "snapshot_id", "p", "status")
    s = fc.latest_by(s, ["event_slug", "ts_us"], [F.desc("snapshot_id")])
    batch = s.where("snapshot_id % 2 = 0").withColumn("p", F.when(F.col("snapshot_id") % 4 == 0, F.col("p") + 1).otherwise(F.col("p")))
    return s.where("snapshot_id % 5 <> 0"), batch


UP = f"{S}, k as (select event_slug, us, snapshot_id, p from s qualify row_number() over (partition by event_slug, us order by snapshot_id desc) = 1)"


@query("j4_upsert_counts", f"with {UP} select count(*) filter (snapshot_id % 2 = 0 and snapshot_id % 5 = 0) as created, count(*) filter (snapshot_id % 4 = 0 and snapshot_id % 5 <> 0) as updated, count(*) filter (snapshot_id % 2 = 0 and snapshot_id % 4 <> 0 and snapshot_id % 5 <> 0) as skipped from k")
def j4(spark, d):
    return fc.upsert_snapshots(*_batch(spark, d))[1]


@query("a9_upsert_rows", f"with {UP} select event_slug, snapshot_id, case when snapshot_id % 4 = 0 then p + 1 else p end as p from k where snapshot_id % 2 = 0 or snapshot_id % 5 <> 0")
def a9(spark, d):
    return fc.upsert_snapshots(*_batch(spark, d))[0].select("event_slug", "snapshot_id", "p")


@query("f5_latest_snapshot", f"with {S} select event_slug, snapshot_id from s qualify row_number() over (partition by event_slug order by us desc, snapshot_id desc) = 1")
def f5(spark, d):
    return fc.latest_by(snapshots(spark, d), ["event_slug"], [F.desc("ts_us"), F.desc("snapshot_id")]).select("event_slug", "snapshot_id")


def examples(spark, d):
    s = snapshots(spark, d)
    labels = fc.label_families(s).select("snapshot_id", nz.resolution_target(F.col("resolved_outcome")).alias("target"))
    return fc.snapshot_features(s.join(labels, "snapshot_id")).withColumn("block", F.floor(F.col("ts_us") / F.lit(86_400_000_000 * 90)))


EX = f"{S}, ex as (select s.*, case when outcome = 'Yes' then 1 else 0 end as target from s join dc using (event_slug))"


@query("k10_features", f"with {EX} select snapshot_id, target, p, abs(p - 0.5) as extremeness, round(ln(1 + volume), 9) as log_volume, round(ln(1 + volume / 2), 9) as log_liquidity, lines::double as related, flags::double as evidence, (lines > 0)::double as has_related, (flags > 0)::double as has_evidence from ex")
def k10(spark, d):
    return examples(spark, d).select("snapshot_id", "target", "p", "extremeness", R("log_volume", 9), R("log_liquidity", 9), "related", "evidence", "has_related", "has_evidence")


BIN = "case when p < 0.2 then 0 when p < 0.4 then 1 when p < 0.2::double * 3 then 2 when p < 0.8 then 3 else 4 end"


@query("e8_forecast_metrics", f"""with {EX}, b as (select {BIN} as bin, count(*) as n, sum((p - target) ** 2) as b, sum(-(target * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - target) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) as l, sum(((p >= 0.5)::int = target)::int) as h, sum(target) as t, sum(p) as q from ex group by 1)
select 'p' as prediction, sum(n)::bigint as examples, round(sum(b) / sum(n), 6) as brier, round(sum(l) / sum(n), 6) as log_loss, round(sum(h) / sum(n), 6) as accuracy, round(sum(abs(t - q)) / sum(n), 6) as calibration_error, round(sum(t) / sum(n), 6) as positive_rate from b having count(*) > 0""")
def e8(spark, d):
    return fc.forecast_metrics(examples(spark, d), ["p"]).select("prediction", "examples", *(R(c) for c in ("brier", "log_loss", "accuracy", "calibration_error", "positive_rate")))


@query("e20_calibration", f"with {EX} select greatest(ceil(p * 5)::int - 1, 0) as bin, count(*) as n, round(avg(target), 6) as observed, round(avg(p), 6) as predicted from ex group by 1")
def e20(spark, d):
    return fc.calibration_table(examples(spark, d)).select("bin", "n", R("observed"), R("predicted"))


@query("e20_profile", f"with {EX} select count(*) as rows, count(distinct event_slug) as events from ex")
def e20b(spark, d):
    return fc.dataset_profile(examples(spark, d))


@query("f11_folds", f"with {EX} select snapshot_id, ord, case when ord > 8 then ord end as fold from (select snapshot_id, row_number() over (order by us, snapshot_id)::int as ord from ex)")
def f11(spark, d):
    return fc.expanding_folds(examples(spark, d), ["ts_us", "snapshot_id"]).select("snapshot_id", "ord", "fold")


@query("k11_logistic")
def k11(spark, d):
    """One model per target-independent group: the year of the snapshot."""
    x = examples(spark, d).withColumn("year", F.year(F.timestamp_micros("ts_us")))
    return fc.fit_logistic(x, "year").select("year", "prior", "weights", "bias")


@query("k12_backtest")
def k12(spark, d):
    return fc.forecast_metrics(fc.forecast_backtest(examples(spark, d)), ["p", "model_probability"])


@query("e9_quality_metrics", f"with {EX}, g as (select target, (flags > 1) as approved, p - target as gap from ex) select count(*) as examples, round(avg(target), 6) as mean_target, round(avg(approved::int), 6) as approval_rate, round(avg(abs(gap)), 6) as mae, round(sqrt(avg(gap * gap)), 6) as rmse from g")
def e9(spark, d):
    x = examples(spark, d).withColumns({"predicted": F.col("p"), "approved": F.col("evidence") > 1})
    return fc.quality_metrics(x).select("examples", *(R(c) for c in ("mean_target", "approval_rate", "mae", "rmse")))


@query("e21_describe", "with x as (select (o_orderkey * 7919) % 1000 / 1000 as p, o_totalprice as v from orders) " + " union all ".join(f"select '{k}' as summary, round({f}(p), 4)::double as p, round({f}(v), 2)::double as volume from x" for k, f in (("count", "count"), ("mean", "avg"), ("stddev", "stddev_samp"), ("min", "min"), ("max", "max"))))
def e21(spark, d):
    """Without the quartiles, which are approximate."""
    x = fc.describe(snapshots(spark, d), ["p", "volume"])
    return x.where("summary not like '%\\%'").select("summary", F.round(F.col("p").cast("double"), 4).alias("p"), F.round(F.col("volume").cast("double"), 2).alias("volume"))


@query("b21_metric_text", "with m as (select o_orderkey, case o_orderkey % 4 when 0 then 'total_cost_usd' when 1 then 'avg_latency_ms' when 2 then 'hit_rate' else 'mae' end as k, o_orderkey::double as v from orders) select o_orderkey, case k when 'total_cost_usd' then 'Total Cost USD' when 'avg_latency_ms' then 'Avg Latency Ms' when 'hit_rate' then 'Hit Rate' else 'MAE' end as label, case when k = 'total_cost_usd' then printf('$%.4f', v) when k = 'avg_latency_ms' then printf('%.0f ms', v) when k = 'hit_rate' and v <= 1 then printf('%.0f', v * 100) || '%' else format('{:,}', v::bigint) end as text from m")
def b21(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.element_at(F.array(*(F.lit(x) for x in ("total_cost_usd", "avg_latency_ms", "hit_rate", "mae"))), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return o.select("o_orderkey", nz.humanize(F.col("k")).alias("label"), nz.format_metric(F.col("k"), F.col("o_orderkey").cast("double")).alias("text"))


@query("b22_trace_cost", "select o_orderkey, round(o_orderkey / 1000000 * case o_orderkey % 3 when 0 then 15.0 when 1 then 3.0 else 0.8 end + (o_orderkey % 100) / 1000000 * case o_orderkey % 3 when 0 then 75.0 when 1 then 15.0 else 4.0 end, 6) as cost from orders")
def b22(spark, d):
    o = table(spark, d, "orders").withColumn("m", F.element_at(F.array(*(F.lit(x) for x in ("claude-opus-4", "claude-sonnet-4", "claude-haiku-3-5"))), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return o.select("o_orderkey", nz.trace_cost(F.col("m"), F.col("o_orderkey"), F.col("o_orderkey") % 100).alias("cost"))


# ---- judgments: line items reviewed by suppliers ----


def judgments(spark, d, by_run=True):
    """Dealt by run, which serves all that is grouped by run and more."""
    x = table(spark, d, "lineitem")
    x = dealt(x, d, "lineitem", "l_orderkey") if by_run else x
    label = F.when(F.col("l_returnflag") == "A", "core").when(F.col("l_returnflag") == "N", "watch").otherwise("reject")
    key = F.concat(F.lit("Market  "), (F.col("l_partkey") % 5).cast("string"))
    return x.select(F.col("l_orderkey").alias("run_id"), key.alias("candidate_key"), key.alias("candidate_title"), label.alias("usefulness_label"), F.concat(F.lit("Reviewer "), F.col("l_suppkey").cast("string")).alias("reviewer"), F.col("l_linenumber").alias("candidate_rank"), (1 - F.col("l_discount")).alias("confidence"), micros("l_shipdate").alias("updated_us"), (F.col("l_orderkey") * 100_000_000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("judgment_id"))


J = """j0 as (select l_orderkey as run_id, 'market ' || (l_partkey % 5) as candidate_key, case l_returnflag when 'A' then 'core' when 'N' then 'watch' else 'reject' end as label, 'reviewer-' || l_suppkey as reviewer_key, l_linenumber as rank, 1 - l_discount as confidence, epoch_us(l_shipdate) as us, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber as id from lineitem),
j as (select * from j0 qualify row_number() over (partition by run_id, candidate_key, reviewer_key order by us desc, id desc) = 1),
v as (select run_id, candidate_key, label, case label when 'core' then 3 when 'watch' then 1 else 0 end as rel, count(*) as n from j group by all),
cs as (select run_id, candidate_key, count(*) as labels, sum(n)::bigint as judgments, sum(n * rel) / sum(n) as mean_relevance, max(n) / sum(n) as agreement_rate, arg_max(label, n * 1000 + rel * 10) as label from v group by all),
rv as (select run_id, candidate_key, count(distinct reviewer_key) as reviewers, max(us) as latest_us from j group by all),
con as (select *, case when reviewers < 2 then 'needs_second_review' when labels > 1 then 'contested' else 'agreed' end as state from cs join rv using (run_id, candidate_key))"""


def _valid(spark, d):
    return rv.validate_judgments(judgments(spark, d))[0]


@query("b28_validate_judgments", f"with {J} select run_id, candidate_key, reviewer_key, label as usefulness_label, id as judgment_id from j")
def b28(spark, d):
    return _valid(spark, d).select("run_id", "candidate_key", "reviewer_key", "usefulness_label", "judgment_id")


@query("b28_rejected_judgments", "select l_orderkey as run_id, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber as judgment_id from lineitem where l_linenumber % 4 = 3 or l_linenumber % 5 = 4")
def b28_rejected(spark, d):
    """Judgments with a label that isn't one, and without a title."""
    j = judgments(spark, d, by_run=False)
    rank = F.col("candidate_rank")
    j = j.withColumns({"usefulness_label": F.when(rank % 4 == 3, "maybe").otherwise(F.concat(F.lit(" "), F.upper("usefulness_label"))), "candidate_title": F.when(rank % 5 == 4, " ").otherwise(F.col("candidate_title"))})
    return rv.validate_judgments(j)[1].select("run_id", "judgment_id")


@query("e5_consensus", f"with {J} select run_id, candidate_key, label, round(agreement_rate, 6) as agreement_rate, round(mean_relevance, 6) as mean_relevance, judgments, reviewers::int as reviewers, state, latest_us from con")
def e5(spark, d):
    return rv.consensus(_valid(spark, d)).select("run_id", "candidate_key", "label", R("agreement_rate"), R("mean_relevance"), "judgments", "reviewers", "state", "latest_us")


def candidates(spark, d):
    j = judgments(spark, d)
    x = j.groupBy("run_id", nz.market_key(F.col("candidate_key")).alias("candidate_key")).agg(F.min("candidate_rank").alias("rank"), F.max("confidence").alias("confidence"))
    more = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("unreviewed").alias("candidate_key"), F.lit(9).alias("rank"), F.lit(0.5).alias("confidence"))
    return x.unionByName(more)


CA = f"{J}, ca as (select run_id, candidate_key, min(rank) as rank, max(confidence) as confidence from j0 group by 1, 2 union all select o_orderkey, 'unreviewed', 9, 0.5 from orders), aj as (select ca.*, label, agreement_rate, mean_relevance, reviewers, coalesce(state, 'pending') as state from ca left join con using (run_id, candidate_key))"


@query("e6_review_summary", f"with {CA}, a as (select count(*) as candidates, count(*) filter (state = 'pending') as pending, count(*) filter (state = 'needs_second_review') as needs_second_review, count(*) filter (state = 'contested') as contested, count(*) filter (state = 'agreed') as agreed, round(coalesce(avg(agreement_rate), 0), 6) as mean_agreement, round(coalesce(avg((reviewers > 1)::int), 0), 6) as multi_reviewer_rate from aj), b as (select count(distinct reviewer_key) as reviewers from j) select * from a, b")
def e6(spark, d):
    s = rv.review_summary(candidates(spark, d), _valid(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_agreement", "multi_reviewer_rate")})


@query("d11_attach_judgments", f"with {CA} select run_id, candidate_key, label, state from aj")
def d11(spark, d):
    return rv.attach_judgments(candidates(spark, d), rv.consensus(_valid(spark, d))).select("run_id", "candidate_key", "label", "state")


PR = f"{CA}, pr as (select *, case state when 'pending' then 40.0 when 'needs_second_review' then 28.0 when 'contested' then 34.0 else 8.0 end + least(greatest(confidence, 0), 1) * 10 + (1 - coalesce(agreement_rate, 0)) * 6 + greatest(0, 6 - greatest(rank, 1)) as priority from aj)"


@query("k14_review_priority", f"with {PR} select run_id, candidate_key, round(priority, 6) as priority from pr")
def k14(spark, d):
    x = rv.attach_judgments(candidates(spark, d), rv.consensus(_valid(spark, d)))
    return x.select("run_id", "candidate_key", F.round(rv.review_priority(F.col("confidence"), F.col("rank"), F.col("state"), F.col("agreement_rate")), 6).alias("priority"))


@query("f12_review_queue", f"with {PR} select run_id, candidate_key, row_number() over (partition by run_id order by priority desc, rank, candidate_key)::int as place from pr qualify place <= 5")
def f12(spark, d):
    return rv.review_queue(candidates(spark, d), rv.consensus(_valid(spark, d))).select("run_id", "candidate_key", "place")


UB = f"{CA}, uj as (select run_id, candidate_key, mean_relevance as relevance, confidence, rank from aj where label is not null), uk as (select run_id from uj group by 1 having count(*) >= 3 and max(relevance) > 0), ub as (select * from uj where run_id in (select run_id from uk))"


@query("e22_usefulness_rows", f"with {UB} select run_id, candidate_key, round(relevance, 6) as relevance from ub")
def e22(spark, d):
    return rv.usefulness_benchmark(_valid(spark, d), candidates(spark, d)).select("run_id", "candidate_key", R("relevance"))


def _metric(sql_score: str, p: str) -> str:
    return f"""{p}r as (select *, row_number() over (partition by query_id order by {sql_score} desc, candidate_id desc) as rk, row_number() over (partition by query_id order by relevance desc, candidate_id desc) as bk from cd),
{p}m as (select query_id, count(*) filter (relevance > 0) as p, count(*) filter (relevance > 0 and rk <= 3) as h, sum(case when rk <= 5 then (2 ** relevance - 1) / log2(rk + 1) else 0 end) as dcg, sum(case when bk <= 5 then (2 ** relevance - 1) / log2(bk + 1) else 0 end) as idcg, min(rk) filter (relevance > 0) as f from {p}r group by 1),
{p}q as (select query_id, case when p > 0 then h / least(p, 3) else 0 end as recall, case when idcg > 0 then dcg / idcg else 0 end as ndcg, coalesce(1 / f, 0) as mrr from {p}m)"""


UC = f"{UB}, cd as (select run_id as query_id, candidate_key as candidate_id, relevance, confidence as s1, (10 - rank)::double as s2 from ub)"


def _bench(spark, d):
    u = rv.usefulness_benchmark(_valid(spark, d), candidates(spark, d))
    return u.select(F.col("run_id").alias("query_id"), F.col("candidate_key").alias("candidate_id"), "relevance", F.col("confidence").alias("baseline"), (10 - F.col("rank")).cast("double").alias("context"))


@query("e7_ranking_metrics", f"with {UC}, {_metric('s1', 'a')} select query_id, round(recall, 6) as recall, round(ndcg, 6) as ndcg, round(mrr, 6) as mrr from aq")
def e7(spark, d):
    return rv.ranking_metrics(_bench(spark, d), "baseline").select("query_id", R("recall"), R("ndcg"), R("mrr"))


CMP = f"with {UC}, {_metric('s1', 'a')}, {_metric('s2', 'b')} select count(*) as queries, " + ", ".join(f"round(avg(aq.{m}), 6) as baseline_{m}, round(avg(bq.{m}), 6) as model_{m}, round(avg(bq.{m}) - avg(aq.{m}), 6) as {m}_lift" for m in ("recall", "ndcg", "mrr")) + " from aq join bq using (query_id)"


@query("e23_golden_compare", CMP)
def e23(spark, d):
    g = rv.golden_eval(rv.compare_rankings(_bench(spark, d)), "compare")
    return g.select("queries", *(R(c) for c in g.columns if c != "queries"))


@query("f10_ranked", f"with {UC} select query_id, candidate_id, row_number() over (partition by query_id order by s1 desc, candidate_id desc)::int as rank from cd")
def f10(spark, d):
    return rv.rank_candidates(_bench(spark, d), "baseline", "query_id", ("candidate_id",)).select("query_id", "candidate_id", "rank")
