"""Top-k retrieval that doesn't score all hits, against scoring all."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketlens.operators import joins
from marketlens.operators import review as rv


def lexical(a, b):
    i = len(a & b)
    return (0.75 * i / len(a | b) if i else 0.0) + min(0.08 * i, 0.32)


@pytest.mark.parametrize(("seed", "seeds"), [(1, 64), (2, 2), (3, 8)])
def test_hard_negatives(spark, seed, seeds):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    pick = lambda most: list({rng.choice(words[: rng.choice([3, 10, 60])]) for _ in range(rng.randint(0, most))})
    queries = [(i, pick(12)) for i in range(40)]
    catalog = [(i, pick(rng.choice([4, 12, 60])), rng.randint(1, 5)) for i in range(400)]
    known = [(q, c) for q, _ in queries for c, _, _ in catalog if rng.random() < (0.97 if q < 5 else 0.1)]
    want = []
    for q, a in queries:
        rest = sorted(((round(lexical(set(a), set(b)), 9), p, c) for c, b, p in catalog if (q, c) not in set(known)), reverse=True)[:12]
        want += [(q, c, s, k) for k, (s, _, c) in enumerate(rest, 1)]
    df = spark.createDataFrame
    q, c, p = df(queries, "query_id long, tokens array<string>"), df(catalog, "candidate_key long, tokens array<string>, popularity int"), df(known, "query_id long, candidate_key long")
    got = rv.hard_negatives(q, c, p, seeds=seeds).collect()
    assert sorted((r.query_id, r.candidate_key, round(r.score, 9), r.place) for r in got) == sorted(want)


def test_negatives_are_compared_once(spark):
    """A pair's words are intersected, and no union of them is made."""
    rows = spark.range(50).selectExpr("id as candidate_key", "array(concat('a', id % 5), concat('b', id % 7)) as tokens", "1 as popularity")
    q = spark.range(5).selectExpr("id as query_id", "array(concat('a', id), concat('b', id)) as tokens")
    plan = rv.hard_negatives(q, rows, spark.createDataFrame([(0, 0)], "query_id long, candidate_key long"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1 and "array_union" not in plan


def test_common_words_are_not_looked_up(spark):
    """Every row has the same four words and two of its own: queries meet few of 3,000 rows."""
    rows = spark.range(3000).selectExpr("id as candidate_key", "array('the', 'that', 'with', 'from', concat('a', id % 150), concat('b', id % 170)) as tokens", "1 as popularity")
    q = spark.range(20).selectExpr("id as query_id", "array('the', 'that', 'with', 'from', concat('a', id), concat('b', id)) as tokens")
    met, _ = rv.negative_candidates(q, rows, spark.createDataFrame([], "query_id long, candidate_key long"))
    assert met.count() < 20 * 3000 * 0.05


def related(events, k=4, enough=12, most_traded=40):
    by = {e[0]: e for e in events}
    traded = [e[0] for e in sorted(events, key=lambda e: (-e[4], e[0]))[:most_traded]]
    out = set()
    import math

    for slug, tags, terms, cat, _, _ in events:
        low = {t.lower() for t in tags}
        met = {o[0] for o in events if o[0] != slug and {t.lower() for t in tags[:3]} & {t.lower() for t in o[1]}}
        if len(met) < enough:
            met |= set(traded) - {slug}
        rows = []
        for o in met:
            _, t2, w2, c2, v, liq = by[o]
            t, w = len(low & {x.lower() for x in t2}), len(set(terms) & set(w2))
            if t or w or cat == c2:
                s = 0.42 + 0.11 * min(t, 3) + 0.05 * min(w, 4) + 0.08 * (cat == c2) + min(math.log10(v + 1) / 18, 0.09) + min(math.log10(liq + 1) / 24, 0.05)
                rows.append((-round(min(max(s, 0.45), 0.94) + 1e-12, 2), o))
        out |= {(slug, o, -s, r) for r, (s, o) in enumerate(sorted(rows)[:k], 1)}
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 13), (2, 25), (3, 200)])
def test_related(spark, seed, limit):
    rng = random.Random(seed)
    events = []
    for i in range(180):
        tags = rng.sample(["Hot", "hot2", "Warm", *(f"t{k}" for k in range(30))], rng.randint(0, 5))
        tags = ["HOT", *tags] if rng.random() < 0.5 else tags
        events.append((f"e{i:03}", tags, rng.sample([f"x{k}" for k in range(8)], rng.randint(0, 6)), rng.choice("abc"), float(rng.choice([0, 10, 1e4, 1e7])), float(rng.choice([0, 500, 1e6]))))
    df = spark.createDataFrame(events, "slug string, tags array<string>, terms array<string>, category string, volume double, liquidity double")
    got = {tuple(r) for r in rv.discover_related(df, limit=limit).select("slug", "other", "score", "rank").collect()}
    assert got == related(events)


def test_hot_tag_meets_few(spark):
    df = spark.range(4000).selectExpr("concat('e', id) as slug", "array('hot', concat('t', id % 800)) as tags", "cast(array() as array<string>) as terms", "concat('c', id % 50) as category", "cast(id as double) as volume", "0.0D as liquidity")
    met, crowded = rv.related_candidates(df)
    assert met.count() < 4000 * 20 and crowded.count() == 4000


def test_related_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Pairs go to as many tasks as their number asks for, before they are made distinct."""
    monkeypatch.setattr(rv, "TASK", 1000, raising=False)
    df = spark.range(4000).selectExpr("concat('e', id) as slug", "array('hot') as tags", "cast(array() as array<string>) as terms", "concat('c', id % 50) as category", "cast(id as double) as volume", "0.0D as liquidity")
    met, _ = rv.related_candidates(df)
    assert met.rdd.getNumPartitions() >= 20 and met.count() == met.distinct().count()


def test_grid_join(spark):
    rows = [(k % 3 if k < 40 else None, k) for k in range(45)]
    a, b = spark.createDataFrame(rows, "key int, x int"), spark.createDataFrame(rows[::-1], "key int, y int")
    for cell in (1, 4, 1000):
        got = sorted((r.key, r.x, r.y) for r in joins.grid_join(a, b, ["key"], cell).collect())
        assert got == sorted((r.key, r.x, r.y) for r in a.join(b, "key").collect())
    assert defaultdict(int, {r["key"]: r["count"] for r in joins.grid_join(a, b, ["key"], 1).groupBy("key").count().collect()})[0] == 14**2


def test_ranking_scores_from_counts(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(14)]
    pick = lambda n: rng.sample(words, rng.randint(0, n))
    queries = [(k, src, sorted({*src, *pick(3)})) for k in range(12) for src in [pick(6)]]
    rows = [(k, title, sorted({*title, *pick(4)})) for k in range(60) for title in [pick(9)]]
    q = spark.createDataFrame(queries, "item long, src array<string>, ctx array<string>")
    c = spark.createDataFrame(rows, "doc long, title array<string>, full array<string>")
    met = rv.matched_words(q, c, "item", "doc")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "array_union" not in plan  # sets are never copied to pairs and compared there
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    want = {}
    for i, src, ctx in queries:
        for d, title, full in rows:
            s, x, t, f = set(src), set(ctx), set(title), set(full)
            if s & t:
                base = 0.75 * alike(s, t) + min(0.08 * len(s & t), 0.32)
                want[i, d] = (round(base, 9), round(0.4 * alike(s, f) + 0.35 * alike(x, f) + min(0.08 * len((x - s) & f), 0.24) + 0.08 * (d % 2 == i % 2) - min(0.01 * (d % 12), 0.08), 9))
    got = rv.ranking_scores(met.withColumns({"same_category": F.col("doc") % 2 == F.col("item") % 2, "popularity": F.col("doc") % 12 + 1}))
    assert {(r.item, r.doc): (round(r.baseline, 9), round(r.context, 9)) for r in got.collect()} == want and len(want) > 100
