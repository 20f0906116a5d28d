"""Strongest paths against walking all of them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators import graphs as gr

NODES = "run_id long, pos int, node_id string, type string"
EDGES = "run_id long, pos int, edge_id string, source string, target string, type string, confidence double"


def walked(nodes, edges):
    """The first best path of each run, as a walk in edge order meets it."""
    out = {}
    for run in {n[0] for n in nodes}:
        start = min((n for n in nodes if n[0] == run and n[3] == "Event"), key=lambda n: n[1], default=None)
        if start is None:
            continue
        near = {}
        for _, pos, _, a, b, kind, c in sorted((e for e in edges if e[0] == run), key=lambda e: e[1]):
            w = round((c + gr.BONUS.get(kind, 0.0)) * 1e9)
            for at, to in ((a, b), (b, a)):
                near.setdefault(at, []).append((to, w))
        best = [None, None]

        def walk(path, score):
            if len(path) > 2 and (best[0] is None or score > best[0]):
                best[:] = score, list(path)
            if len(path) < 5:
                for to, w in near.get(path[-1], []):
                    if to not in path:
                        walk([*path, to], score + w)

        walk([start[2]], 0)
        if best[1]:
            out[run] = (best[0], best[1])
    return out


@pytest.mark.parametrize(("seed", "held"), [(0, 5000), (1, 9), (2, 0)])
def test_like_a_walk(spark, seed, held):
    rng = random.Random(seed)
    nodes, edges = [], []
    for run in range(120):
        n = rng.randint(1, 9)
        nodes += [(run, k, f"n{k}", "Event" if k in (run % 3, 5) else "Entity") for k in range(n)]
        grades = rng.choice([[0.5], [0.5, 0.51], [0.0, 0.2, 0.9], [k / 100 for k in range(100)]])
        for pos in range(rng.randint(0, 18)):
            a, b = rng.randint(0, n - 1), rng.randint(0, n - 1)
            edges.append((run, pos, f"e{pos}", f"n{a}", f"n{b}", rng.choice([*gr.EDGE_TYPES, "unknown"]), rng.choice(grades)))
    edges.append((0, 99, "e99", "", "n0", "mentions", 0.9))
    got = gr.strongest_path(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), held).collect()
    assert {r.run_id: (round(r.score * 1e9), r.path) for r in got} == walked(nodes, [e for e in edges if e[3]])


def test_hub_is_not_squared(spark):
    """A node with 20,000 neighbours, every one of which knows the next two."""
    n = 20_000
    nodes = spark.createDataFrame([(1, 0, "hub", "Event")], NODES)
    ids = spark.range(n)
    edge = lambda a, b, c, k: ids.selectExpr("1L as run_id", f"cast(id * 3 + {k} as int) as pos", "'e' as edge_id", f"{a} as source", f"{b} as target", "'mentions' as type", f"{c} as confidence")
    edges = edge("'hub'", "'n' || id", "id / 40000.0D", 0).unionByName(edge("'n' || id", f"'n' || (id + 1) % {n}", "0.5D", 1)).unionByName(edge("'n' || id", f"'n' || (id + 2) % {n}", "0.5D", 2))
    r = gr.strongest_path(nodes, edges).first()
    assert r.path[:2] == ["hub", f"n{n - 1}"] and len(r.path) == 5 and abs(r.score - ((n - 1) / 40000 + 1.5 + 4 * 0.02)) < 1e-9


def test_sides_dealt_by_run(spark):
    """Runs whose nodes and edges come out of shuffles by run, the edges much larger: each run's rows still meet in one task."""
    n = 3000
    ids = spark.range(n).select(F.col("id").alias("run_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    edges = ids.groupBy("run_id", "k").agg(F.max(F.lit("why " * 200)).alias("explanation")).withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("k")))
    edges = edges.select("run_id", "pos", F.concat(F.lit("e"), "pos").alias("edge_id"), F.when(F.col("k") % 2 == 0, "o").otherwise(F.concat(F.lit("p"), F.col("k") - 1)).alias("source"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("p"), "k")).otherwise(F.concat(F.lit("s"), "k")).alias("target"), F.lit("related_to").alias("type"), F.lit(0.9).alias("confidence"), "explanation")
    nodes = spark.range(n).select(F.col("id").alias("run_id"), F.lit("o").alias("node_id"), F.lit("Event").alias("type"), F.lit(0).alias("pos"))
    plan = gr.strongest_path(nodes, edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Union")  # above it: else adaptive execution may merge partitions of each side on its own
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"), spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        got = gr.strongest_path(nodes, edges).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", before[1])
    assert {(r.run_id, tuple(r.path)) for r in got} == {(k, ("o", "p0", "s1")) for k in range(n)}
