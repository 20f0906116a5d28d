"""What a query reads, shuffles and holds doesn't grow faster than its tables."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from marketlens.operators import forecast as fc
from marketlens.operators import graphs as gr
from marketlens.plans import adapters, catalog, graph_queries


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain()
    return text.getvalue()


@pytest.mark.parametrize("name,scans", [("k13_graph_quality", 2), ("b26_clean_nodes", 2), ("h1_graph_diff", 2), ("e3_trust_examples", 2), ("e18_validate_graph", 4)])
def test_graph_reads_lines_once_for_each_side(spark, sf_dir, name, scans):
    assert plan(catalog.QUERIES[name](spark, sf_dir)).count("lineitem.parquet") <= scans


def test_more_tasks_for_more_input(spark, sf_dir):
    x = adapters.table(spark, sf_dir, "lineitem")
    few, many = (adapters.dealt(x, sf_dir, "lineitem", "l_orderkey", each=each) for each in (1 << 40, 1 << 10))
    assert many.rdd.getNumPartitions() > 50 and few.rdd.getNumPartitions() <= 8
    assert sorted(few.select("l_orderkey").collect()) == sorted(many.select("l_orderkey").collect())


def test_depths_of_small_and_large_runs_agree(spark, sf_dir):
    nodes, edges = graph_queries.graph(spark, sf_dir)
    nodes, edges = nodes.where("run_id % 20 = 0"), edges.where("run_id % 20 = 0").withColumn("source", F.when(F.col("pos") == 4, "").otherwise(F.col("source")))
    by_run, joined, mixed = (sorted(map(tuple, gr.bfs_depth(nodes, edges, held=h).select("run_id", "node_id", "depth").collect())) for h in (5000, 0, 9))
    assert by_run == joined == mixed and {d for *_, d in by_run} > {0, 1, 2}


def test_violations_are_listed_as_often_as_they_stand(spark):
    n = spark.createDataFrame([(1, "a", "Event", "x"), (1, "a", "Odd", " "), (1, "a", "Odd", None), (None, "b", "Event", "x")], "run_id int, node_id string, type string, label string")
    e = spark.createDataFrame([(1, "e", "mentions", "a", "a"), (1, "e", "odd", "a", "c"), (1, None, "odd", None, "a"), (None, "f", "mentions", "b", "b")], "run_id int, edge_id string, type string, source string, target string")
    got = sorted(gr.validate_graph(n, e).collect(), key=str)
    want = [(1, "duplicate_node", "a"), (1, "duplicate_edge", "e"), (1, "node_type", "a"), (1, "node_type", "a"), (1, "node_label", "a"), (1, "node_label", "a"), (1, "edge_type", "e"), (1, "edge_type", None), (1, "dangling_target", "e"), (1, "dangling_source", None), (None, "dangling_source", "f"), (None, "dangling_target", "f")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_steps_read_matrices_and_shuffle_nothing(spark, monkeypatch):
    """Rows of far and narrow values, which are written as a matrix a group and file, give the models of one task."""
    made, kept = {}, fc.kept
    monkeypatch.setattr(fc, "kept", lambda df, label, **options: made.setdefault(label, kept(df, label, **options)))
    df = spark.range(600).selectExpr("id % 3 as block", "1e6 + (id * 7919) % 101 as a", "(id * 31) % 17 / 1e3 as b", "4.0 as c", "cast((id * 7919) % 101 + id % 40 > 70 as int) as target").repartition(2)
    one, many = ({r.block: r for r in fc.fit_logistic(df, "block", ["a", "b", "c"], 30, held).collect()} for held in (1000, 0))
    for k in one:
        assert all(abs(x - y) < 1e-8 for x, y in zip([one[k].bias, *one[k].weights], [many[k].bias, *many[k].weights], strict=True))
    assert made["matrices"].count() <= 3 * 2 and set(made["matrices"].columns) == {"lo", "hi", "rows"}


@pytest.mark.parametrize("name", ["d11_attach_judgments", "k14_review_priority", "e22_usefulness_rows", "e23_golden_compare", "f12_review_queue", "f10_ranked", "e6_review_summary"])
def test_judgments_are_attached_once(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "collect_set" not in text and text.count("lineitem.parquet") <= 3 and text.count("Join") <= 3


def test_built_nodes_are_made_once(spark, sf_dir):
    text = plan(catalog.QUERIES["i2_build_edges"](spark, sf_dir))
    assert "orders.parquet" not in text and "customer.parquet" not in text


def test_more_landed_files_give_the_same_snapshots(spark, sf_dir, monkeypatch):
    from marketlens.plans import source_queries as sq

    monkeypatch.setattr(adapters, "size", lambda *_: 40 << 20)
    at, made = {}, sq.new_dir
    monkeypatch.setattr(sq, "new_dir", lambda s, label: at.setdefault(label, made(s, label)))
    many = sorted(map(tuple, catalog.QUERIES["l5_collect_snapshots"](spark, sf_dir).collect()))
    assert len(spark.read.parquet(at["snapshots"]).inputFiles()) > 8 and spark.read.parquet(f"{at['collected']}/reports/*").count() == 3
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert [r[0] for r in many] == sorted(r[0] for r in o.select("o_custkey").distinct().collect())


def test_brief_makes_its_graph_once(spark, sf_dir, monkeypatch):
    """Parts of the brief read written nodes and edges, not lines, and leave no shuffle of lines to the last step."""
    made, settled = {}, gr.settled
    monkeypatch.setattr(gr, "settled", lambda df, label, **options: made.setdefault(label, (df, settled(df, label, **options)))[1])
    text = plan(catalog.QUERIES["i7_market_brief"](spark, sf_dir))
    assert "lineitem.parquet" not in text and {"nodes", "edges", "paths", "changes", "moved", "trust"} <= set(made)
    assert all(("lineitem.parquet" in plan(df)) == (label in ("nodes", "edges")) for label, (df, _) in made.items() if label in ("nodes", "edges", "changes", "moved"))


def test_paths_need_no_edge_ids(spark, sf_dir):
    """Neither those of small runs nor those of large ones."""
    nodes, edges = (x.where("run_id % 40 = 0") for x in graph_queries.graph(spark, sf_dir))
    one, two = (sorted((r.run_id, round(r.score, 9), r.path) for r in gr.strongest_path(nodes, edges.drop("edge_id"), held=h).collect()) for h in (5000, 2))
    assert one == two != []


def test_settled_tables_leave_no_shuffle_files(spark, tmp_path):
    """What a settled table shuffled is gone once it is written; the setting of the session stays."""
    from marketlens.scratch import settled

    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum(1 for f in top.getAllFiles().toSeq().mkString("\n").split("\n") if "shuffle_" in f)
    x = spark.range(20_000).withColumn("k", F.col("id") % 997).groupBy("k").agg(F.collect_list("id").alias("ids"))
    before = count()
    assert settled(x, "rows").count() == 997
    assert count() <= before + 4  # the count's own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
