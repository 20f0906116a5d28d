"""Typed market graphs: features, checks, paths, diffs, edits, trust and briefs.

nodes: run_id, pos, node_id, type, label, summary, source_url, confidence, volume. edges: run_id, pos, edge_id, source,
target, type, confidence, explanation. Both are keyed by run_id, so that one hash partitioning serves all joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import nlargest
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import delete, kept, settled
from ..shipping import ready

# Allowed types, bonuses of edge types on a path, how direct an edge type is, month and event words.
NODE_TYPES = ["Event", "Entity", "RelatedMarket", "Evidence", "Rule", "Hypothesis"]
EDGE_TYPES = ["mentions", "involves", "supported_by", "related_to", "affects_directly", "affects_indirectly", "governed_by_rule"]
BONUS = {"mentions": 0.02, "involves": 0.03, "supported_by": 0.02, "related_to": 0.04, "affects_directly": 0.08, "affects_indirectly": 0.05, "governed_by_rule": -0.02}
DIRECTNESS = {"affects_directly": 92, "governed_by_rule": 86, "supported_by": 78, "involves": 70, "related_to": 62, "affects_indirectly": 58, "mentions": 44}
CONCEPTUAL = ["Entity", "Evidence", "Rule", "Hypothesis"]
CATALYST = r"(?i)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|q[1-4]|week|quarter|fomc|cpi|jobs report|earnings|meeting|election|debate|deadline)\b"


def _map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def _some(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) != ""


def graph_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run: counts by type, confidences, density e / (n (n - 1)), edge-type diversity, and the volume of related markets against the event's."""
    n = nodes.groupBy("run_id").agg(F.count("*").alias("node_count"), *(F.count_if(F.col("type") == t).alias(f"n_{t.lower()}") for t in NODE_TYPES), F.avg("confidence").alias("avg_node_confidence"), F.sum(F.when(F.col("type") == "RelatedMarket", F.col("volume")).otherwise(0.0)).alias("related_volume"), F.coalesce(F.max(F.when(F.col("type") == "Event", F.col("volume"))), F.lit(0.0)).alias("event_volume"))
    kinds = edges.groupBy("run_id", "type").agg(F.count("*").alias("n"), F.count("confidence").alias("k"), F.sum("confidence").alias("s"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    e = kinds.groupBy("run_id").agg(F.sum("n").alias("edge_count"), (F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("avg_edge_confidence"), F.min("lo").alias("min_edge_confidence"), F.max("hi").alias("max_edge_confidence"), F.count("type").cast("int").alias("edge_type_diversity"))
    x = n.join(e, "run_id", "left").na.fill(0)
    most = F.when(F.col("node_count") > 1, F.col("node_count") * (F.col("node_count") - 1)).otherwise(1)
    ratio = F.when(F.col("event_volume") != 0, F.col("related_volume") / F.col("event_volume")).otherwise(0.0)
    return x.withColumns({"density": F.col("edge_count") / most, "related_volume_ratio": ratio})


def graph_quality(features: DataFrame, expanded: str | None = None) -> DataFrame:
    """features with quality: a sum of rules from 0.5, at most 0.95."""
    plus = lambda when, x: F.when(when, x).otherwise(0.0)
    s = F.lit(0.5) + plus(F.col("node_count") >= 8, 0.1) + plus(F.col("n_relatedmarket") >= 2, 0.08) + plus(F.col("n_evidence") >= 2, 0.07) + plus(F.col("n_hypothesis") >= 1, 0.05)
    s = s + plus(F.col("avg_edge_confidence") > 0.7, 0.05) + plus(F.col("edge_type_diversity") >= 4, 0.05) + plus(F.col("density") > 0.1, 0.03)
    if expanded:
        s = s + plus(F.col(expanded), 0.08)
    return features.withColumn("quality", F.round(F.least(s, F.lit(0.95)), 2))


def citations(nodes: DataFrame, k: int = 8) -> DataFrame:
    """Per run: the distinct source URLs of its nodes, where each first stands, the first k."""
    first = nodes.where(_some("source_url")).groupBy("run_id", "source_url").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("pos", "source_url"))
    kept_ = first.withColumn("_r", rank).where(F.col("_r") <= k)
    return kept_.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "source_url"))), lambda x: x["source_url"]).alias("citations"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("run_id").agg(F.count("*").alias("nodes"), F.countDistinct("type").alias("node_types"))
    return n.join(edges.groupBy("run_id").agg(F.count("*").alias("edges")), "run_id", "left").na.fill(0)


def verifier_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run: source-backed, evidence-backed and unsupported nodes (conceptual ones with neither source, snippets nor metadata), edges without explanation, and completed or fallback."""
    held = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    bare = F.col("type").isin(*CONCEPTUAL) & ~_some("source_url") & ~held("snippets") & ~held("metadata")
    n = nodes.groupBy("run_id").agg(F.count_if(_some("source_url")).alias("source_backed"), F.count_if(held("snippets")).alias("evidence_backed"), F.count_if(bare).alias("unsupported"))
    x = n.join(edges.groupBy("run_id").agg(F.count_if(~_some("explanation")).alias("unexplained")), "run_id", "left").na.fill(0)
    return x.withColumn("status", F.when((F.col("unsupported") == 0) & (F.col("unexplained") == 0), "completed").otherwise("fallback"))


def structural_review(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run: what its graph lacks, whether it is approved, and 0.88 or 0.63."""
    n = nodes.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "RelatedMarket").alias("m"))
    x = n.join(edges.groupBy("run_id").agg(F.count_if(F.col("type") == "affects_indirectly").alias("i")), "run_id", "left").na.fill(0)
    issues = F.array_compact(F.array(F.when(F.col("n") < 6, "few_nodes"), F.when(F.col("m") == 0, "no_related_market"), F.when(F.col("i") == 0, "no_indirect_edge")))
    return x.select("run_id", issues.alias("issues"), (F.size(issues) == 0).alias("approved"), F.when(F.size(issues) == 0, 0.88).otherwise(0.63).alias("quality"))


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations (run_id, kind, id): duplicate ids, unknown types, missing labels, edges without their ends.

    Nodes and edges are grouped by id once each for all that one can tell of a row or its id; a count says how often a violation
    is listed. Both ends of the edges look for their nodes in one join, which is a shuffle of both sides.
    """
    per = lambda df, c, prefix, **found: df.groupBy("run_id", F.col(c).alias("id")).agg(F.when(F.count("*") > 1, 1).otherwise(0).cast("long").alias(f"duplicate_{prefix}"), *(F.count_if(when).alias(kind) for kind, when in found.items()))
    n = per(nodes, "node_id", "node", node_type=~F.col("type").isin(*NODE_TYPES), node_label=~_some("label"))
    e = per(edges, "edge_id", "edge", edge_type=~F.col("type").isin(*EDGE_TYPES))

    def listed(df: DataFrame) -> DataFrame:
        kinds = [c for c in df.columns if c not in ("run_id", "id")]
        some = df.where(" or ".join(f"{k} > 0" for k in kinds))
        each = some.select("run_id", "id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds))).alias("x")).where("x.n > 0")
        return each.select("run_id", F.col("x.kind").alias("kind"), "id", F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("_")).drop("_")

    ids = nodes.select("run_id", F.col("node_id").alias("end")).distinct()
    ends = edges.select("run_id", F.col("edge_id").alias("id"), F.inline(F.array(*(F.struct(F.lit(f"dangling_{end}").alias("kind"), F.col(end).alias("end")) for end in ("source", "target")))))
    loose = ends.join(ids.hint("merge"), ["run_id", "end"], "left_anti").select("run_id", "kind", "id")
    return listed(n).unionByName(listed(e)).unionByName(loose)


def _adjacency(edges: DataFrame) -> DataFrame:
    one = lambda a, b: edges.where((F.col("source") != "") & (F.col("target") != "")).select("run_id", F.col(a).alias("at"), F.col(b).alias("to"), "pos", (F.col("confidence") + F.coalesce(F.try_element_at(_map(BONUS), F.col("type")), F.lit(0.0))).alias("w"))
    return one("source", "target").unionByName(one("target", "source"))


def _starts(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'Event'").groupBy("run_id").agg(F.min_by("node_id", "pos").alias("at"))


def strongest_path(nodes: DataFrame, edges: DataFrame, held: int = 5000) -> DataFrame:
    """Per run with such a path: the best simple path of two to four edges from its first Event node, by the sum of confidence and bonus; the first in edge order on ties.

    Sums that agree to nine decimals are ties; of parallel edges only the best counts. A path is a head of two edges and a
    tail of none to two that meet in its middle node. A tail must avoid the run's first node and the one node between it and the
    middle, so that three tails for each node are enough: the best, and the best without either of that one's nodes. In the same way a
    tail's last edge is among the three best of the node before. Thus the work grows with the edges, whatever the nodes' degrees.
    Runs of at most `held` edges meet in one shuffle, and a task holds one of them at a time; larger ones take joins on run and node.
    """
    ready(edges.sparkSession)
    whole = edges.where(F.col("run_id").isNotNull() & (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
    large = kept(whole.groupBy("run_id").count().where(F.col("count") > held).select("run_id"), "large-runs")
    starts = _starts(nodes).select("run_id", F.col("at").alias("start"))
    if large.isEmpty():
        return _small_runs(starts, whole)
    big = F.broadcast(large) if large.count() <= 1_000_000 else large
    part = lambda df, how: df.join(big, "run_id", how)
    return _small_runs(part(starts, "left_anti"), part(whole, "left_anti")).unionByName(_large_runs(part(starts, "left_semi"), part(whole, "left_semi")))


def _weight() -> tuple[Column, Column]:
    w = F.col("confidence") + F.coalesce(F.try_element_at(_map(BONUS), F.col("type")), F.lit(0.0))
    return w, F.round(w * 1e9).cast("long")


def best_path(start: str, edges: Iterable[tuple[int, str, str, float, int]]) -> tuple[float, list[str]] | None:
    """strongest_path of one run: edges are (position, one end, other end, weight, weight in units of 1e-9)."""
    near: dict[str, dict[str, tuple[int, int, float]]] = {}
    for pos, a, b, w, u in edges:
        e = (u, -pos, w)
        for at, to in ((a, b), (b, a)):
            if to != start and (old := near.setdefault(at, {}).get(to)) is None or to != start and e > old:
                near[at][to] = e
    three = {at: nlargest(3, ((u, o, to, w) for to, (u, o, w) in by.items())) for at, by in near.items() if at != start}
    known: dict[str, tuple] = {}

    def tails(x: str) -> tuple:
        if x not in known:
            found = [(u, o, 2**62, y, "", w, 0.0) for y, (u, o, w) in near.get(x, {}).items()]
            found += [(t[0] + u, t[1], o, t[3], z, t[5], w) for t in found for u, o, z, w in [n for n in three.get(t[3], ()) if n[2] != x][:2]]
            best = max(found, default=None)
            known[x] = (best, *(max((t for t in found if node not in (t[3], t[4])), default=None) for node in (best and best[3], best and best[4])))
        return known[x]

    out = None
    for a, (u1, o1, w1) in near.get(start, {}).items():
        for x, (u2, o2, w2) in near.get(a, {}).items():
            best, not_y, not_z = tails(x)
            t = not_y if best and best[3] == a else not_z if best and best[4] == a else best
            paths = [(u1 + u2, o1, o2, 2**62, 2**62, w1 + w2, [start, a, x])]
            if t:
                paths.append((u1 + u2 + t[0], o1, o2, t[1], t[2], w1 + w2 + t[5] + t[6], [start, a, x, t[3], t[4]]))
            out = max(paths if out is None else [out, *paths])
    return out and (out[5], [n for n in out[6] if n])


def _small_runs(starts: DataFrame, edges: DataFrame) -> DataFrame:
    w, u = _weight()
    kind = edges.schema["run_id"].dataType.simpleString()
    rows = edges.select("run_id", F.col("pos").cast("long").alias("pos"), "source", "target", w.alias("w"), u.alias("u"))
    first = starts.select("run_id", F.lit(None).cast("long").alias("pos"), F.col("start").alias("source"), F.lit("").alias("target"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("u"))
    # By a hash of the run: sides that are dealt by run_id already would meet without a shuffle, and adaptive execution then merges the partitions of each on its own.
    sorted_ = rows.unionByName(first).repartition(F.xxhash64("run_id")).sortWithinPartitions("run_id", F.col("pos").asc_nulls_first())

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (r for b in batches for r in zip(b["run_id"].tolist(), b["pos"].isna().tolist(), b["pos"].fillna(0).astype("int64").tolist(), *(b[c].tolist() for c in ("source", "target", "w", "u")), strict=True))
        out: list[tuple] = []
        for run, group in groupby(stream, key=lambda r: r[0]):
            head = next(group)
            best = best_path(head[3], (r[2:] for r in group)) if head[1] else None
            if best:
                out.append((run, *best))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["run_id", "score", "path"])
                out = []
        yield pd.DataFrame(out, columns=["run_id", "score", "path"])

    return sorted_.mapInPandas(solve, f"run_id {kind}, score double, path array<string>")


def _large_runs(starts: DataFrame, edges: DataFrame) -> DataFrame:
    most = F.lit(2**62)
    one = _adjacency(edges).groupBy("run_id", "at", "to").agg(F.max(F.struct(F.round(F.col("w") * 1e9).cast("long").alias("u"), (-F.col("pos")).cast("long").alias("o"), "w")).alias("e"))
    adjacency = kept(one.join(starts, "run_id").where(F.col("to") != F.col("start")).select("run_id", "at", "to", "start", "e.*"), "adjacency")
    first, rest = adjacency.where("at = start"), adjacency.where("at <> start")

    rank = F.row_number().over(Window.partitionBy("run_id", "at").orderBy(F.desc("u"), F.desc("o"), "to"))
    three = rest.withColumn("_r", rank).where("_r <= 3").groupBy("run_id", "at").agg(F.sort_array(F.collect_list(F.struct("_r", "u", "o", "w", "to"))).alias("next"))
    hops = rest.select("run_id", F.col("at").alias("x"), F.col("to").alias("y"), "u", "o", "w").join(three.withColumnRenamed("at", "y"), ["run_id", "y"], "left")
    tail = lambda u, o, w, z: F.struct((F.col("u") + u).alias("u"), F.col("o").alias("o3"), o.alias("o4"), "y", z.alias("z"), F.col("w").alias("w3"), w.alias("w4"))
    alone = F.array(tail(F.lit(0).cast("long"), most, F.lit(0.0), F.lit("")))
    after = F.slice(F.filter(F.coalesce("next", F.array()), lambda n: n["to"] != F.col("x")), 1, 2)
    tails = hops.select("run_id", "x", F.explode(F.concat(alone, F.transform(after, lambda n: tail(n["u"], n["o"], n["w"], n["to"])))).alias("t"))
    tails = tails.withColumn("best", F.max("t").over(Window.partitionBy("run_id", "x")))
    without = lambda node: F.max(F.when((F.col("t.y") != F.col(node)) & (F.col("t.z") != F.col(node)), F.col("t")))
    tails = tails.groupBy("run_id", "x").agg(F.max("best").alias("best"), without("best.y").alias("not_y"), without("best.z").alias("not_z"))

    heads = first.select("run_id", "start", F.col("to").alias("at"), F.col("u").alias("u1"), F.col("o").alias("o1"), F.col("w").alias("w1")).join(rest.drop("start"), ["run_id", "at"])
    heads = heads.select("run_id", "start", F.col("at").alias("a"), F.col("to").alias("x"), (F.col("u1") + F.col("u")).alias("u"), "o1", F.col("o").alias("o2"), (F.col("w1") + F.col("w")).alias("w"))
    t = F.when(F.col("best.y") == F.col("a"), F.col("not_y")).when(F.col("best.z") == F.col("a"), F.col("not_z")).otherwise(F.col("best"))
    both = heads.join(tails, ["run_id", "x"], "left").withColumn("t", t)
    path = lambda u, o3, o4, score, *more: F.struct(u.alias("u"), "o1", "o2", o3.alias("o3"), o4.alias("o4"), score.alias("score"), F.array("start", "a", "x", *more).alias("path"))
    whole = path(F.col("u") + F.col("t.u"), F.col("t.o3"), F.col("t.o4"), F.col("w") + F.col("t.w3") + F.col("t.w4"), "t.y", "t.z")
    short = path(F.col("u"), most, most, F.col("w"))
    out = both.groupBy("run_id").agg(F.max(F.array_max(F.array(short, F.when(F.col("t").isNotNull(), whole)))).alias("b"))
    return out.select("run_id", "b.score", F.filter("b.path", lambda x: x != "").alias("path"))


def bfs_depth(nodes: DataFrame, edges: DataFrame, most: int = 4, held: int = 5000) -> DataFrame:
    """Depth of each node from its run's first Event; most where it is further away or out of reach.

    Runs of at most `held` edges are gone through where their rows meet, in one shuffle, and a task holds the edges of one of them at a
    time; of larger ones neighbours and each frontier are joined.
    """
    ready(edges.sparkSession)
    whole = edges.where(F.col("run_id").isNotNull() & (F.col("source") != "") & (F.col("target") != ""))
    large = kept(whole.groupBy("run_id").count().where(F.col("count") > held).select("run_id"), "large-runs")
    if large.isEmpty():
        return _small_depths(nodes, whole, most)
    big = F.broadcast(large) if large.count() <= 1_000_000 else large
    part = lambda df, how: df.join(big, "run_id", how)
    return _small_depths(part(nodes, "left_anti"), part(whole, "left_anti"), most).unionByName(_large_depths(part(nodes, "left_semi"), part(whole, "left_semi"), most))


def _small_depths(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Rows of a run come in this order: its Events by pos, of which the first is the start; its edges; its nodes, equal ones together."""
    tiers = F.when((F.col("type") == "Event") & F.col("run_id").isNotNull(), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(2)))
    rows = nodes.select("run_id", F.explode(tiers).alias("tier"), F.col("pos").cast("long").alias("pos"), F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"))
    rows = rows.withColumn("pos", F.when(F.col("tier") == 0, F.col("pos")))
    rows = rows.unionByName(edges.select("run_id", F.lit(1).alias("tier"), F.lit(None).cast("long").alias("pos"), F.col("source").alias("a"), F.col("target").alias("b")))
    # By a hash of the run, as in _small_runs.
    sorted_ = rows.repartition(F.xxhash64("run_id")).sortWithinPartitions("run_id", "tier", F.col("pos").asc_nulls_last(), "a")
    kind = nodes.schema["run_id"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        types = [head.schema.field("run_id").type, pa.string(), pa.int32()]
        made = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["run_id", "node_id", "depth"])
        stream = (r for t in chain([head], batches) for r in zip(*(t.column(c).to_pylist() for c in ("run_id", "tier", "a", "b")), strict=True))
        out = ([], [], [])
        for run, group in groupby(stream, key=lambda r: r[0]):
            start, near, depth, last = (), {}, None, ()
            for _, tier, a, b in group:
                if tier == 0:
                    start = start or (a,)
                elif tier == 1:
                    near.setdefault(a, []).append(b)
                    near.setdefault(b, []).append(a)
                else:
                    if depth is None:
                        depth = depths(start[0] if start else None, near, most)
                    if last != (a,):
                        last = (a,)
                        for column, value in zip(out, (run, a, depth.get(a, most)), strict=True):
                            column.append(value)
                        if len(out[0]) >= 10_000:
                            yield made(out)
                            out = ([], [], [])
        yield made(out)

    return sorted_.mapInArrow(solve, f"run_id {kind}, node_id string, depth int")


def depths(start: str | None, near: dict[str, list[str]], most: int) -> dict[str, int]:
    """Steps from start to each node that fewer than most of them reach."""
    out = {} if start is None else {start: 0}
    front = list(out)
    for k in range(1, most):
        front = [b for b in dict.fromkeys(b for a in front for b in near.get(a, ())) if b not in out]
        out.update(dict.fromkeys(front, k))
    return out


def _large_depths(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    adjacency = kept(_adjacency(edges).select("run_id", F.col("at").alias("node_id"), "to").distinct(), "adjacency")
    reach = kept(_starts(nodes).select("run_id", F.col("at").alias("node_id"), F.lit(0).alias("depth")), "reach")
    front = reach
    for k in range(1, most):
        front = front.join(adjacency, ["run_id", "node_id"]).select("run_id", F.col("to").alias("node_id")).distinct().join(reach, ["run_id", "node_id"], "left_anti").withColumn("depth", F.lit(k))
        front = kept(front, "front")
        reach = reach.unionByName(front)
    return nodes.select("run_id", "node_id").distinct().join(reach, ["run_id", "node_id"], "left").na.fill({"depth": most})


def visible_subgraph(nodes: DataFrame, edges: DataFrame, types: list[str], min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Nodes of types and edges of enough confidence between them; nodes without such an edge go, Events stay."""
    kept = nodes.where(F.col("type").isin(*types, "Event"))
    ids = kept.select("run_id", "node_id")
    strong = edges.where(F.col("confidence") >= min_confidence)
    for end in ("source", "target"):
        strong = strong.join(ids.withColumnRenamed("node_id", end), ["run_id", end], "left_semi")
    ends = strong.select("run_id", F.explode(F.array("source", "target")).alias("node_id")).distinct().withColumn("_e", F.lit(True))
    return kept.join(ends, ["run_id", "node_id"], "left").where("_e or type = 'Event'").drop("_e"), strong


def node_scores(nodes: DataFrame) -> DataFrame:
    """Confidence, context, support and clarity of nodes in percent. metadata and snippets are arrays, summary text."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    size = F.length(F.coalesce("summary", F.lit("")))
    return nodes.withColumns({
        "confidence_score": F.least(F.greatest(F.rint(F.col("confidence") * 100), F.lit(0.0)), F.lit(100.0)).cast("int"), "context_score": F.least(F.lit(100), 18 + n("metadata") * 18 + F.when(size > 0, 14).otherwise(0)),
        "support_score": F.least(F.lit(100), n("snippets") * 32), "clarity_score": F.when(size > 0, F.least(F.lit(100), 24 + F.floor(F.least(size, F.lit(140)) / 2))).otherwise(20).cast("int"),
    })


def edge_scores(edges: DataFrame) -> DataFrame:
    """Confidence, directness, explanation and their blend for edges, in percent."""
    size = F.length(F.coalesce("explanation", F.lit("")))
    x = edges.withColumns({
        "confidence_score": F.least(F.greatest(F.rint(F.col("confidence") * 100), F.lit(0.0)), F.lit(100.0)).cast("int"), "directness_score": F.coalesce(F.try_element_at(_map(DIRECTNESS), F.col("type")), F.lit(60)),
        "explanation_score": F.when(size > 0, F.least(F.lit(100), 18 + F.floor(F.least(size, F.lit(180)) / 2))).otherwise(24).cast("int"),
    })
    return x.withColumn("signal_score", F.rint((F.col("confidence_score") + F.col("directness_score") + F.col("explanation_score")) / 3).cast("int"))


def clean_nodes(nodes: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Metadata without a label or value and blank snippets dropped; what is empty filled in.

    A summary is filled with the page's description, the event's, or type and label; the source's title with the page's or
    the label, its description with the page's or the summary; the URL of an Event or RelatedMarket with the event's. An
    Event takes title, description and URL of the event where they are given. events: run_id, event_title,
    event_description, event_url. page_title and page_description (landed pages) may be columns of nodes.
    """
    has = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    facts = ["event_title", "event_description", "event_url"]
    x = nodes.join(events.select("run_id", *facts), "run_id", "left") if events is not None else nodes.withColumns({c: F.lit(None).cast("string") for c in facts})
    first = lambda *cs: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs), F.lit(""))
    event = F.col("type") == "Event"
    x = x.withColumns({"source_title": has("source_title"), "source_description": has("source_description"), "_title": has("page_title"), "_text": has("page_description")})
    x = x.withColumn("summary", F.when(event & _some("event_description"), F.col("event_description")).otherwise(first(F.col("summary"), F.col("_text"), F.col("event_description"), F.concat(F.col("type"), F.lit(": "), F.col("label")))))
    x = x.withColumns({
        "source_title": F.when(event & _some("event_title"), F.col("event_title")).otherwise(first(F.col("source_title"), F.col("_title"), F.col("label"))), "source_description": F.when(event & _some("event_description"), F.col("event_description")).otherwise(first(F.col("source_description"), F.col("_text"), F.col("summary"))),
        "source_url": F.when(event & _some("event_url"), F.col("event_url")).when(F.col("type").isin("Event", "RelatedMarket"), first(F.col("source_url"), F.col("event_url"))).otherwise(first(F.col("source_url"))),
    })
    return x.drop(*facts, "_title", "_text").withColumns({
        "metadata": F.filter(F.coalesce("metadata", F.array().cast("array<struct<label:string,value:string>>")), lambda m: (F.trim(m["label"]) != "") & (F.trim(m["value"]) != "")),
        "snippets": F.filter(F.transform(F.coalesce("snippets", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda s: s != ""),
    })


def top_nodes(nodes: DataFrame, type_: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("confidence"), "pos"))
    return nodes.where(F.col("type") == type_).withColumn("rank", rank).where(F.col("rank") <= k)


def catalysts(nodes: DataFrame, k: int = 5) -> DataFrame:
    """Per run: nodes that name a month, quarter or scheduled event, one per (type, label), the k of most confidence."""
    said = [c for c in ("label", "summary", "description") if c in nodes.columns]
    hit = nodes.where(_some("label") & F.concat_ws(" ", *said).rlike(CATALYST))
    first = F.row_number().over(Window.partitionBy("run_id", "type", "label").orderBy("pos"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("confidence"), "pos"))
    return hit.withColumn("_f", first).where("_f = 1").drop("_f").withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_run(runs: DataFrame, mode: str = "lag") -> DataFrame:
    """runs (run_id, event_slug, created_us) with other_id: the run of the slug before it, or with newest_other its newest other run."""
    w = Window.partitionBy("event_slug").orderBy("created_us", "run_id")
    if mode == "lag":
        return runs.withColumn("other_id", F.lag("run_id").over(w))
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    newest = F.last("run_id").over(all_)
    second = F.lead("run_id").over(Window.partitionBy("event_slug").orderBy(F.desc("created_us"), F.desc("run_id")))
    return runs.withColumns({"_n": newest, "_s": second}).withColumn("other_id", F.when(F.col("_n") != F.col("run_id"), F.col("_n")).otherwise(F.col("_s"))).drop("_n", "_s")


def previous_run(runs: DataFrame, by: str = "event_slug", fallback: str = "source_url") -> DataFrame:
    """runs with previous_id: the run before of the same slug, else of the same URL."""
    lag = lambda key: F.lag("run_id").over(Window.partitionBy(key).orderBy("created_us", "run_id"))
    return runs.withColumns({"_a": lag(by), "_b": lag(fallback)}).withColumn("previous_id", F.coalesce("_a", "_b")).drop("_a", "_b")


def graph_diff(nodes: DataFrame, run_pairs: DataFrame, k: int = 5) -> DataFrame:
    """Per (run_id, other_id): labels of the nodes, told apart by (type, label), that the run added and lost against the other, the first k in order; of added evidence the first 3; and by how many nodes they differ."""
    keys = nodes.groupBy("run_id").agg(F.collect_set(F.struct("label", "type")).alias("keys"))
    x = run_pairs.join(keys, "run_id").join(keys.select(F.col("run_id").alias("other_id"), F.col("keys").alias("old")), "other_id")
    delta = (F.size("keys") - F.size("old")).alias("node_delta")
    both = F.struct(F.array_except("keys", "old").alias("plus"), F.array_except("old", "keys").alias("minus"), delta)
    x = x.select("run_id", "other_id", F.inline(F.array(both)))  # a generator: each difference is made once
    labels = lambda c, n, kind=None: F.slice(F.array_sort(F.transform(F.filter(c, lambda r: (r["label"] != "") & ((r["type"] == kind) if kind else F.lit(True))), lambda r: r["label"])), 1, n)
    return x.select("run_id", "other_id", labels("plus", k).alias("added"), labels("minus", k).alias("removed"), labels("plus", 3, "Evidence").alias("added_evidence"), "node_delta")


def graph_changes(nodes: DataFrame, edges: DataFrame, run_pairs: DataFrame) -> DataFrame:
    """graph_diff with edge_delta, the market that moved most, status (changed or stable) and a summary in words."""
    sizes = edges.select("run_id", "source", "target", "type").distinct().groupBy("run_id").agg(F.count("*").alias("e"))
    x = graph_diff(nodes, run_pairs).join(sizes, "run_id", "left").join(sizes.select(F.col("run_id").alias("other_id"), F.col("e").alias("f")), "other_id", "left").na.fill(0, ["e", "f"])
    top = moved_markets(nodes, run_pairs).where("rank = 1").select("run_id", "other_id", F.col("label").alias("moved"), F.col("delta").alias("moved_delta"))
    x = x.join(top, ["run_id", "other_id"], "left").withColumn("edge_delta", F.col("e") - F.col("f"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    bits = F.array_compact(F.array(
        F.when(F.size("added") > 0, text(F.size("added"), " new nodes surfaced")), F.when(F.size("removed") > 0, text(F.size("removed"), " nodes dropped")),
        F.when(F.col("edge_delta") != 0, text(F.abs("edge_delta"), F.when(F.col("edge_delta") > 0, " more").otherwise(" fewer"), " edges than the prior run")),
        F.when(F.col("moved").isNotNull(), text("top related confidence moved ", F.when(F.col("moved_delta") > 0, "up").otherwise("down"), " in ", F.col("moved"))),
    ))
    return x.drop("e", "f").withColumns({"status": F.when(F.size(bits) > 0, "changed").otherwise("stable"), "summary": F.array_join(bits, "; ")})


def moved_markets(nodes: DataFrame, run_pairs: DataFrame, k: int = 4, least: float = 0.01) -> DataFrame:
    """Related markets of both runs of a pair whose confidence moved by least or more, the k largest moves."""
    m = nodes.where("type = 'RelatedMarket'").groupBy("run_id", "label").agg(F.max("confidence").alias("c"))
    x = run_pairs.join(m, "run_id").join(m.select(F.col("run_id").alias("other_id"), "label", F.col("c").alias("old")), ["other_id", "label"])
    x = x.withColumn("delta", F.round(F.col("c") - F.col("old"), 2)).where(F.abs("delta") >= least)
    rank = F.row_number().over(Window.partitionBy("run_id", "other_id").orderBy(F.desc(F.abs("delta")), "label"))
    return x.withColumn("rank", rank).where(F.col("rank") <= k).select("run_id", "other_id", "label", "delta", "rank")


def apply_edits(nodes: DataFrame, edges: DataFrame, updates: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, max_nodes: int = 4, max_edges: int = 6) -> tuple[DataFrame, DataFrame]:
    """Labels, summaries and source URLs replaced by id; at most max_nodes new nodes and max_edges new edges per run, of known types, with new ids and valid ends. A source URL without http, https or a host is replaced by the Event's."""
    event = nodes.where("type = 'Event'").groupBy("run_id").agg(F.min_by("source_url", "pos").alias("_event"))
    plausible = lambda c: F.coalesce(F.col(c).rlike(r"^https?://[^/?#\s]+"), F.lit(False))
    if "source_url" in new_nodes.columns:
        new_nodes = new_nodes.join(event, "run_id", "left").withColumn("source_url", F.when(plausible("source_url"), F.col("source_url")).otherwise(F.coalesce("_event", F.lit("")))).drop("_event")
    url = F.max("source_url") if "source_url" in updates.columns else F.max(F.lit(None).cast("string"))
    u = updates.groupBy("run_id", "node_id").agg(F.max("label").alias("_l"), F.max("summary").alias("_s"), F.nullif(url, F.lit("")).alias("_u"))
    one = lambda df, key: df.withColumn("_k", F.row_number().over(Window.partitionBy("run_id", key).orderBy("pos", "type"))).where("_k = 1").drop("_k")
    changed = nodes.join(u, ["run_id", "node_id"], "left").join(event, "run_id", "left")
    changed = changed.withColumns({"label": F.coalesce("_l", "label"), "summary": F.coalesce("_s", "summary"), "source_url": F.when(F.col("_u").isNull(), F.col("source_url")).when(plausible("_u"), F.col("_u")).otherwise(F.coalesce("_event", F.lit("")))}).select(*nodes.columns)
    rank = lambda df: df.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy("pos", "type")))
    fresh = new_nodes.where(F.col("type").isin(*NODE_TYPES)).join(nodes.select("run_id", "node_id"), ["run_id", "node_id"], "left_anti")
    fresh = one(fresh, "node_id")
    out_nodes = changed.unionByName(rank(fresh).where(F.col("_r") <= max_nodes).select(*nodes.columns))
    ids = out_nodes.select("run_id", "node_id")
    add = new_edges.where(F.col("type").isin(*EDGE_TYPES)).join(edges.select("run_id", "edge_id"), ["run_id", "edge_id"], "left_anti")
    add = one(add, "edge_id")
    for end in ("source", "target"):
        add = add.join(ids.withColumnRenamed("node_id", end), ["run_id", end], "left_semi")
    return out_nodes, edges.unionByName(rank(add).where(F.col("_r") <= max_edges).select(*edges.columns))


def _confidence(c: Column) -> Column:
    return F.round(F.least(F.greatest(c, F.lit(0.45)), F.lit(0.99)), 2)


def _short(c: Column, most: int) -> Column:
    """Text with single blanks, cut to most characters with an ellipsis."""
    clean = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, most - 1)), F.lit("...")))


def build_nodes(events: DataFrame, candidates: DataFrame, entities: int = 4, related: int = 4, hypotheses: int = 2) -> DataFrame:
    """Nodes of event snapshots, in the order pos.

    events: run_id, title, tags, description, category, volume, liquidity, updated_at, rule (the resolution source), source_url
    and markets (array of struct with question and slug). candidates: run_id, slug, title, score, rationale, source_url.
    Each run gets its Event; entities of title and tags, else its category and the market's participants; evidence of its
    description, of its size where it has any, and of its last update where it is known; the related candidates of the
    highest scores, else its own first three markets; its Rule where it has one; and hypotheses of the first candidates,
    else one on the narrative. Events and the candidates taken are written once, as each kind of node reads them.
    """
    from ..functions.normalize import node_slug
    from ..functions.tokens import entity_labels

    def row(df: DataFrame, kind: str, key: Column, label: Column, summary: Column, confidence: Column, pos: Column, url: Column | None = None) -> DataFrame:
        source = F.coalesce(F.col("source_url") if url is None else url, F.lit(""))
        return df.select("run_id", pos.cast("int").alias("pos"), key.alias("node_id"), F.lit(kind).alias("type"), label.alias("label"), summary.alias("summary"), source.alias("source_url"), confidence.cast("double").alias("confidence"))

    e, none = kept(events, "events"), F.lit("")
    join = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    said = F.when(_some("description"), F.col("description")).otherwise(F.col("title"))
    found = F.transform(entity_labels(F.col("title"), F.col("tags"), entities), lambda x: x["label"])
    names = F.when(F.size(found) > 0, found).otherwise(F.array(F.col("category"), F.lit("Market participants")))
    ent = e.select("*", F.posexplode(names).alias("i", "x")).withColumn("k", F.col("i") + 1)
    sized = (F.coalesce("volume", F.lit(0.0)) != 0) | (F.coalesce("liquidity", F.lit(0.0)) != 0)
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "slug"))
    rel = kept(candidates.withColumn("k", rank).where(F.col("k") <= related), "related")
    bare = e.join(rel.where("k = 1").select("run_id"), "run_id", "left_anti")
    own = bare.select("*", F.posexplode(F.slice("markets", 1, 3)).alias("i", "m")).withColumn("k", F.col("i") + 1)
    name = F.when(F.trim(F.coalesce("m.question", none)) != "", F.col("m.question")).when(F.trim(F.coalesce("m.slug", none)) != "", F.col("m.slug")).otherwise(join("Adjacent market ", F.col("k")))
    slug = node_slug(F.when(_some("slug"), F.col("slug")).otherwise(F.col("title")))
    host = F.replace(F.regexp_extract(F.coalesce("rule", none), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), none)
    parts = [
        row(e, "Event", F.lit("evt_001"), F.col("title"), said, F.lit(1.0), F.lit(0)),
        row(ent, "Entity", join("ent_", F.col("k"), "_", node_slug(F.col("x"))), F.col("x"), none, _confidence(0.66 + F.col("k") * 0.05), F.col("k"), none),
        row(rel, "RelatedMarket", join("mkt_", F.col("k"), "_", slug), F.col("title"), F.coalesce("rationale", none), F.col("score"), 10 + F.col("k")),
        row(own, "RelatedMarket", join("mkt_fallback_", F.col("k"), "_", node_slug(name)), name, F.lit("A market of the event itself."), _confidence(0.61 - F.col("k") * 0.03), 10 + F.col("k")),
        row(e, "Evidence", F.lit("ev_description"), F.lit("Market description"), _short(said, 150), F.lit(0.87), F.lit(21), none),
        row(e.where(sized), "Evidence", F.lit("ev_market_structure"), F.lit("Volume and liquidity signal"), F.lit("How much is traded and offered."), F.lit(0.79), F.lit(22), none),
        row(e.where(_some("updated_at")), "Evidence", F.lit("ev_timing"), F.lit("Market timing context"), F.lit("When it was last updated."), F.lit(0.73), F.lit(23), none),
        row(e.where(_some("rule")), "Rule", F.lit("rule_resolution"), join("Resolution source: ", F.when(host != "", host).otherwise("Public resolution source")), F.lit("Where it is settled."), F.lit(0.96), F.lit(30), none),
        row(rel.where(F.col("k") <= hypotheses), "Hypothesis", join("hyp_", F.col("k"), "_", slug), join(_short(F.col("title"), 54), " reprices through narrative spillover"), none, _confidence(F.col("score") - 0.05), 40 + F.col("k"), none),
        row(bare, "Hypothesis", F.lit("hyp_fallback_narrative"), F.lit("Narrative spillover reprices adjacent contracts"), none, F.lit(0.61), F.lit(41), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_edges(nodes: DataFrame) -> DataFrame:
    """Edges of built nodes: from the Event to each other node; and from the first two entities, evidence and hypotheses to the first related market, of the lesser confidence less a step. Confidences lie in [0.45, 0.99]. What is read of the nodes is written once."""
    from ..functions.normalize import node_slug

    nodes = kept(nodes.select("run_id", "node_id", "type", "confidence", "pos"), "nodes")
    kind = _map({"Entity": "involves", "Evidence": "supported_by", "RelatedMarket": "related_to", "Rule": "governed_by_rule", "Hypothesis": "affects_indirectly"})
    root = nodes.where("type = 'Event'").select("run_id", F.col("node_id").alias("source"))
    spokes = nodes.where("type <> 'Event'").join(root, "run_id").select("run_id", "source", F.col("node_id").alias("target"), F.element_at(kind, F.col("type")).alias("type"), _confidence(F.col("confidence")).alias("confidence"), "pos")
    ranked = nodes.withColumn("_r", F.row_number().over(Window.partitionBy("run_id", "type").orderBy("pos")))
    market = ranked.where("type = 'RelatedMarket' and _r = 1").select("run_id", F.col("node_id").alias("target"), F.col("confidence").alias("b"))
    step = _map({"Entity": 0.04, "Evidence": 0.08, "Hypothesis": 0.03})
    to = _map({"Entity": "affects_directly", "Evidence": "mentions", "Hypothesis": "affects_indirectly"})
    cross = ranked.where("type in ('Entity', 'Evidence', 'Hypothesis') and _r <= 2").join(market, "run_id").select("run_id", F.col("node_id").alias("source"), "target", F.element_at(to, F.col("type")).alias("type"), _confidence(F.least("confidence", "b") - F.element_at(step, F.col("type"))).alias("confidence"), (F.col("pos") + 100).alias("pos"))
    return spokes.unionByName(cross).withColumn("edge_id", F.concat_ws("_", F.lit("edge"), node_slug(F.col("source")), node_slug(F.col("target")), "type"))


def context_tokens(nodes: DataFrame) -> DataFrame:
    """Per run: the distinct ranking tokens of its Entity, Evidence and Hypothesis nodes, in order."""
    from ..functions.tokens import ranking_tokens

    x = nodes.where(F.col("type").isin("Entity", "Evidence", "Hypothesis")).select("run_id", F.explode(ranking_tokens(F.col("label"), F.col("summary"))).alias("t"))
    return x.groupBy("run_id").agg(F.array_sort(F.collect_set("t")).alias("tokens"))


def trust_examples(nodes: DataFrame, edges: DataFrame, reviews: DataFrame, traces: DataFrame) -> DataFrame:
    """Per run of reviews (run_id, approved, issue_count): rates of unsupported, explained and cited parts, and the trust score."""
    concept = F.col("type").isin(*CONCEPTUAL)
    bare = concept & ~_some("source_url") & (F.coalesce(F.size("snippets"), F.lit(0)) <= 0) & (F.coalesce(F.size("metadata"), F.lit(0)) <= 0)
    n = nodes.groupBy("run_id").agg(F.count("*").alias("nodes"), F.count_if(concept).alias("c"), F.count_if(bare).alias("u"), F.count_if(_some("source_url")).alias("sb"), F.count_if(concept & (F.size("snippets") > 0)).alias("eb"))
    e = edges.groupBy("run_id").agg(F.count("*").alias("edges"), F.count_if(_some("explanation")).alias("x"))
    cited = F.col("stage").isin("retriever", "graph_editor") & (F.col("status") == "completed")
    told = F.col("stage").isin("graph_editor", "critic", "llm_expansion", "llm_review")
    live = (F.col("latency_ms") > 0) | (F.col("tokens") > 0) | (F.col("cost_usd") > 0)
    t = traces.groupBy("run_id").agg(F.count_if(cited).alias("ct"), F.count_if(cited & (F.col("citations") > 0)).alias("cb"), F.count_if(told).alias("tt"), F.count_if(told & live).alias("tb"))
    x = reviews.join(n, "run_id", "left").join(e, "run_id", "left").join(t, "run_id", "left").na.fill(0)
    rate = lambda a, b, none: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(none)
    x = x.withColumns({"unsupported_rate": rate("u", "c", 0.0), "explained_rate": rate("x", "edges", 1.0), "source_rate": rate("sb", "nodes", 0.0), "evidence_rate": rate("eb", "c", 0.0), "citation_rate": rate("cb", "ct", 1.0), "telemetry_rate": rate("tb", "tt", 0.0)})
    score = 0.35 * (1 - F.col("unsupported_rate")) + 0.20 * F.col("explained_rate") + 0.20 * F.col("citation_rate") + F.when(F.col("approved"), 0.15).otherwise(0.0) + 0.10 * (1 - F.least(F.col("issue_count") / 3, F.lit(1.0)))
    return x.select("run_id", "unsupported_rate", "explained_rate", "source_rate", "evidence_rate", "citation_rate", "telemetry_rate", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("trust"))


def trust_report(examples: DataFrame) -> DataFrame:
    trust = F.round("trust", 6)
    band = lambda lo, hi: F.count_if((trust >= lo) & (trust < hi))
    return examples.agg(F.count("*").alias("runs"), *(F.avg(c).alias(c) for c in ("trust", "unsupported_rate", "explained_rate", "citation_rate")), band(0.8, 9).alias("high"), band(0.6, 0.8).alias("medium"), band(-1, 0.6).alias("low"))


def caveats(reviews: DataFrame, stats: DataFrame, k: int = 4) -> DataFrame:
    """Per run: its first three issues and what its graph lacks, k at most."""
    x = reviews.join(stats, "run_id", "left").na.fill(0)
    own = F.array_compact(F.array(F.when(~F.col("approved"), "not_approved"), F.when(F.col("nodes") < 6, "small_graph"), F.when(F.col("edges") < 4, "few_edges")))
    return x.select("run_id", F.slice(F.concat(F.slice("issues", 1, 3), own), 1, k).alias("caveats"))


def market_brief(nodes: DataFrame, edges: DataFrame, runs: DataFrame, reviews: DataFrame, traces: DataFrame) -> DataFrame:
    """One wide row per run: best path, top related markets, evidence and catalyst, changes and moved markets against the run before, trust, caveats, health of its traces."""
    from .traces import canonical_traces, trace_summary

    ranked = lambda df, what, name: df.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", what.alias("x")))), lambda r: r["x"]).alias(name))
    # Nodes and edges are read by ten parts: they are made once. Parts that shuffle much are written before the next begins, so that
    # what they shuffle doesn't stand on disk together.
    needs = ["run_id", "node_id", "pos", "type", "label", "confidence", "summary", "description", "source_url", "snippets", "metadata"]
    nodes = settled(nodes.select(*(c for c in needs if c in nodes.columns)), "nodes")
    edges = settled(edges.drop("edge_id"), "edges")
    paths = settled(strongest_path(nodes, edges), "paths")
    trust = settled(trust_examples(nodes, edges, reviews.withColumn("issue_count", F.size("issues")), traces).select("run_id", "trust"), "trust")
    lacks = settled(caveats(reviews, graph_stats(nodes, edges)), "caveats")
    delete(nodes.sparkSession, {f.rsplit("/", 1)[0] for f in edges.inputFiles()})
    pairs = settled(neighbour_run(runs).where("other_id is not null").select("run_id", "other_id"), "pairs")
    changes = settled(graph_diff(nodes, pairs).drop("other_id"), "changes")
    moved = moved_markets(nodes, pairs).withColumn("_text", F.concat_ws(" ", "label", F.format_string("%+.2f", "delta")))
    moved = settled(ranked(moved, F.col("_text"), "moved"), "moved")
    out = runs.select("run_id", "event_slug").join(paths, "run_id", "left")
    out = out.join(ranked(top_nodes(nodes, "RelatedMarket", 4), F.col("label"), "related"), "run_id", "left").join(ranked(top_nodes(nodes, "Evidence", 3), F.col("label"), "evidence"), "run_id", "left")
    out = out.join(catalysts(nodes).where("rank = 1").select("run_id", F.col("label").alias("next_catalyst")), "run_id", "left")
    for part in (changes, moved, trust):
        out = out.join(part, "run_id", "left")
    out = out.join(trace_summary(canonical_traces(traces)).select("run_id", F.col("stages").alias("trace_stages"), F.col("health").alias("trace_health")), "run_id", "left")
    return out.join(lacks, "run_id", "left")
