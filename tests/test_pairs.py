"""Bounded pair generation against all pairs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import tokens as tk
from marketlens.operators import leadlag as ll

WORDS = [*tk.DRIVERS, *tk.ASSETS, "election", "party", "march", "april", "winner", "market", "before", *(f"word{k}" for k in range(25))]


def catalog(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        common = ["crypto"] * (rng.random() < 0.5)  # half of all titles have it
        title = " ".join(common + rng.sample(WORDS, rng.choice([0, 1, 2, 3, 5, 8])) + rng.choice([[], ["fed", "cpi"], ["bitcoin", "gold", "stock"]]))
        rows.append((rng.choice("ab"), i, rng.choice([title, title, "", "who will win this year"]), rng.choice(["", "", " ".join(rng.sample(WORDS, 12))]), rng.sample(WORDS, rng.choice([0, 0, 1])), rng.choice(["2026-03-18", "june", "by 30 june 2031", ""]), rng.choice([0.0, 5e4, 2e5]), rng.choice([0.0, 3e4]), rng.choice([0.0, 9e4])))
    df = spark.createDataFrame(rows, "venue string, market_id long, title string, resolution_text string, tags array<string>, resolution_window string, volume double, liquidity double, open_interest double")
    m = ll.with_tokens(df).persist()
    return m.where("venue = 'a'"), m.where("venue = 'b'")


def found(pairs):
    return {(r.l_market_id, r.r_market_id): round(r.composite, 9) for r in pairs.collect()}


@pytest.mark.parametrize(("seed", "stability", "min_score", "cell"), [(1, 1.0, 0.38, 1000), (2, 1.0, 0.38, 7), (3, 0.0, 0.38, 1000), (4, 0.5, 0.45, 10)])
def test_loses_no_pair(spark, seed, stability, min_score, cell):
    left, right = catalog(spark, seed, 260)
    keys = ["l_venue", "l_market_id", "r_venue", "r_market_id"]
    every = ll.candidate_pairs(left, right, "cross")
    stable = every.select(*keys, F.lit(stability).alias("score"), F.lit("ready").alias("readiness_status"))
    want = found(ll.score_pairs(every, stable, min_score))
    bounded = ll.bounded_pairs(left, right, min_score, stability, cell)
    assert bounded.select(keys).distinct().count() == bounded.count() and bounded.columns == every.columns
    assert found(ll.score_pairs(bounded, stable, min_score)) == want and len(want) > 100


def test_common_token_makes_few_pairs(spark):
    """3,000 markets that share one topic and little else."""
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("venue"), F.col("id").alias("market_id"), F.expr("concat('crypto thing', id, ' item', id % 977, ' part', id % 601)").alias("title"), F.lit("").alias("resolution_text"), F.array().cast("array<string>").alias("tags"), F.expr("concat('window', id)").alias("resolution_window"), F.lit(1.0).alias("volume"), F.lit(1.0).alias("liquidity"), F.lit(1.0).alias("open_interest"))
    m = ll.with_tokens(df)
    left, right = m.where("venue = 'a'"), m.where("venue = 'b'")
    n = ll.candidate_pairs(left, right, "bounded").count()
    assert n < 40_000 < 2_250_000 == ll.candidate_pairs(left, right).count()


def test_odd_catalogs(spark):
    left, right = catalog(spark, 5, 30)
    assert ll.bounded_pairs(left.where("false"), right).count() == 0 == ll.bounded_pairs(left, right.where("false")).count()
    with pytest.raises(ValueError):
        ll.bounded_pairs(left, right, 0.2)


@pytest.mark.parametrize("mode", ["blocked", "bounded"])
def test_pairs_are_not_shuffled(spark, mode):
    """Markets go to their keys, with what scores need: nothing is exchanged once pairs are made, and each comes once."""
    left, right = catalog(spark, 6, 120)
    pairs = ll.candidate_pairs(left, right, mode)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3 and "Aggregate" not in plan  # one of markets, at most one a side for heavy keys
    ids = [(r.l_market_id, r.r_market_id) for r in pairs.select("l_market_id", "r_market_id").collect()]
    assert len(ids) == len(set(ids)) > 100


def test_own_stability(spark):
    """Stability in columns of pairs gives what the join with a table of it gives."""
    left, right = catalog(spark, 7, 120)
    keys = ["l_venue", "l_market_id", "r_venue", "r_market_id"]
    n = F.col("l_market_id") + F.col("r_market_id")
    every = ll.candidate_pairs(left, right, "cross")
    table = every.select(*keys, ((n % 10) / 10).alias("score"), F.when(n % 3 != 0, "ready").otherwise("watch_only").alias("readiness_status"))
    own = ll.bounded_pairs(left, right).withColumns({"stability": (n % 10) / 10, "ready": n % 3 != 0})
    assert found(ll.score_pairs(own)) == found(ll.score_pairs(every, table)) != {}


def repeated(spark, n=600):
    """Markets of twelve titles and four windows, each with sizes of its own."""
    left, right = catalog(spark, 8, 12)
    texts = left.unionByName(right).drop("venue", "market_id", "volume", "liquidity")
    ids = spark.range(n).selectExpr("case when id % 2 = 0 then 'a' else 'b' end as venue", "id as market_id", "id * 977.0 as volume", "(id % 3) * 9000.0 as liquidity", "id div 2 % 12 as _k")
    numbered = texts.withColumn("_k", F.row_number().over(Window.orderBy("title", "window_toks", "toks")) - 1)
    m = ids.join(F.broadcast(numbered), "_k").drop("_k").persist()
    return m.where("venue = 'a'"), m.where("venue = 'b'")


@pytest.mark.parametrize("stability", [0.0, 1.0])
def test_equal_token_sets_are_compared_once(spark, monkeypatch, stability):
    """300 x 300 markets of twelve texts: at most 144 are compared, and every market's pairs come out with its own sizes."""
    left, right = repeated(spark)
    met = []
    monkeypatch.setattr(ll, "meet", lambda *a, meet=ll.meet, **k: met.append(meet(*a, **k)) or met[-1])
    ready = {"stability": F.lit(stability), "ready": F.lit(False)}
    got = found(ll.score_pairs(ll.similar_pairs(left, right, 0.38, stability).withColumns(ready)))
    assert 0 < met[0].count() <= 144
    assert got == found(ll.score_pairs(ll.candidate_pairs(left, right, "cross").withColumns(ready))) and len(got) > 5000


def test_members_are_dealt_into_rows(spark):
    left, right = repeated(spark, 200)
    few, many = ll.alike(left), ll.alike(left, 3)
    assert many.agg(F.max(F.size("members"))).first()[0] <= 3 < few.agg(F.max(F.size("members"))).first()[0]
    ids = lambda x: sorted(r[0] for r in x.select(F.explode("members.market_id")).collect())
    assert ids(few) == ids(many) == list(range(0, 200, 2))


def test_keys_of_one_side_are_not_shuffled(spark, monkeypatch):
    """Only keys that both sides have are joined, each with what comes before it: markets of words of their own and one in common have one."""
    sides = []
    monkeypatch.setattr(ll, "grid_join", lambda a, b, *x, join=ll.grid_join: sides.extend([a, b]) or join(a, b, *x))
    df = spark.range(400).selectExpr("case when id % 2 = 0 then 'a' else 'b' end as venue", "id as market_id", "concat('crypto own', id, ' other', id) as title", "'' as resolution_text", "cast(array() as array<string>) as tags", "concat('window', id) as resolution_window", "1.0 as volume", "1.0 as liquidity", "1.0 as open_interest")
    m = ll.with_tokens(df)
    assert ll.candidate_pairs(m.where("venue = 'a'"), m.where("venue = 'b'")).count() == 200 * 200
    assert [x.count() for x in sides] == [200, 200]


def test_parts_of_sets_are_counted_right(spark):
    """What sides share is as by intersection, whether their sets are equal, nested or apart."""
    every = ll.candidate_pairs(*catalog(spark, 9, 80), "cross")
    got = ll.pair_similarity(every)
    shared = lambda k: F.size(F.array_intersect(f"l_{k}", f"r_{k}"))
    similar = lambda k: F.when(shared(k) > 0, shared(k) / F.size(F.array_union(f"l_{k}", f"r_{k}"))).otherwise(0.0)
    wrong = (F.col("overlap") != shared("theme")) | (F.col("n_shared") != shared("topics"))
    for name, k in (("j_all", "toks"), ("j_theme", "theme"), ("j_title", "title_theme"), ("j_window", "window_toks")):
        wrong |= F.abs(F.col(name) - similar(k)) > 1e-12
    assert got.count() > 1000 and got.where(wrong).count() == 0
    nested = (F.size("l_theme") < F.size("l_toks")) & (F.size("r_topics") < F.size("r_toks"))
    assert got.where(nested).count() > 0 and got.where("size(l_window_toks) = 0 and size(r_window_toks) = 0").count() > 0
