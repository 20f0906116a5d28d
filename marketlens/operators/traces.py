"""Agent traces: canonical rows, coverage, summaries, backfill and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import trace_cost

STAGES = ["planner", "retriever", "graph_editor", "verifier", "critic"]


def canonical_traces(traces: DataFrame) -> DataFrame:
    """The newest trace of each run and required stage; traces of other stages are all kept. Only required ones are ranked, so that no other stage piles up under a key."""
    required = F.col("stage").isin(*STAGES)
    last = F.row_number().over(Window.partitionBy("run_id", "stage").orderBy(F.desc("created_us"), F.desc("trace_id")))
    return traces.where(required).withColumn("_r", last).where("_r = 1").drop("_r").unionByName(traces.where(~required))


def instrumentation_report(traces: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of coverage metrics over canonical traces (citations, latency_ms, tokens, cost_usd, llm)."""
    t = canonical_traces(traces)
    active, llm = F.col("status") != "skipped", F.col("llm") | F.col("stage").isin("llm_expansion", "llm_review")
    per_run = t.groupBy("run_id").agg(F.size(F.array_intersect(F.collect_set("stage"), F.array(*(F.lit(s) for s in STAGES)))).alias("k"))
    a = t.agg(F.count("*").alias("trace_count"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("citations") > 0).alias("cited"), F.count_if(active).alias("active"), F.count_if(active & (F.col("latency_ms") > 0)).alias("timed"), F.count_if(llm).alias("llm_count"), F.count_if(llm & (F.col("tokens") > 0)).alias("counted"), F.count_if(llm & (F.col("cost_usd") > 0)).alias("priced"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.avg(F.when(active & (F.col("latency_ms") > 0), F.col("latency_ms"))).alias("avg_latency_ms"))
    b = per_run.agg(F.count("*").alias("traced_runs"), F.count_if(F.col("k") == len(STAGES)).alias("complete_runs"), F.avg(F.col("k") / len(STAGES)).alias("avg_stage_coverage"))
    x = a.crossJoin(b).crossJoin(runs.agg(F.count("*").alias("run_count")))  # one row each
    rate = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    return x.select("trace_count", "completed", "failed", "total_tokens", rate("traced_runs", "run_count").alias("run_coverage_rate"), rate("complete_runs", "run_count").alias("required_stage_coverage_rate"), F.coalesce("avg_stage_coverage", F.lit(0.0)).alias("avg_required_stage_coverage"), rate("cited", "trace_count").alias("citation_coverage_rate"), rate("timed", "active").alias("latency_coverage_rate"), rate("counted", "llm_count").alias("token_coverage_rate"), rate("priced", "llm_count").alias("cost_coverage_rate"), "llm_count", F.coalesce("avg_latency_ms", F.lit(0.0)).alias("avg_latency_ms"))


def trace_summary(traces: DataFrame) -> DataFrame:
    """Per run: counts by status, totals and a health class."""
    n = lambda s: F.count_if(F.col("status") == s)
    health = F.when(n("failed") > 0, "partial").when(n("fallback") > 0, "fallback").otherwise("clean")
    return traces.groupBy("run_id").agg(F.count("*").alias("stages"), n("completed").alias("completed"), n("fallback").alias("fallback"), n("failed").alias("failed"), F.sum("latency_ms").alias("total_latency_ms"), F.sum("tokens").alias("total_tokens"), F.sum("citations").alias("citations"), health.alias("health"))


def coverage_metrics(runs: DataFrame, nodes: DataFrame, traces: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: runs, means a run of nodes, edges, evidence, related markets and traces, and the mean of the runs' best related market."""
    n = nodes.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "Evidence").alias("v"), F.count_if(F.col("type") == "RelatedMarket").alias("m"), F.max(F.when(F.col("type") == "RelatedMarket", F.col("confidence"))).alias("best"))
    t = traces.groupBy("run_id").agg(F.count("*").alias("t"))
    e = edges.groupBy("run_id").agg(F.count("*").alias("e"))
    x = runs.select("run_id").join(n, "run_id", "left").join(e, "run_id", "left").join(t, "run_id", "left").na.fill(0, ["n", "v", "m", "e", "t"])
    return x.agg(F.count("*").alias("runs"), F.avg("n").alias("avg_nodes"), F.avg("e").alias("avg_edges"), F.avg("v").alias("avg_evidence_nodes"), F.avg("m").alias("avg_related_markets"), F.coalesce(F.avg("best"), F.lit(0.0)).alias("avg_best_related"), F.avg("t").alias("avg_traces"))


def backfill_traces(runs: DataFrame, traces: DataFrame) -> DataFrame:
    """Rows for required stages that a run has no trace of, from its log (run_id, created_us, log map<stage, status>); a stage that the log lacks is skipped. Backfilling twice adds nothing."""
    want = runs.select("run_id", "created_us", "log", F.posexplode(F.array(*(F.lit(s) for s in STAGES))).alias("pos", "stage"))
    status = F.coalesce(F.try_element_at("log", F.col("stage")), F.lit("skipped"))
    return want.join(traces.select("run_id", "stage").distinct(), ["run_id", "stage"], "left_anti").select("run_id", "stage", status.alias("status"), (F.col("created_us") + F.col("pos")).alias("created_us"), F.lit("backfill").alias("source"))


# The parts of a run's payload that stages are rebuilt from. Numbers and lists of objects are read as text, as either may come as the other.
PIPELINE = "array<struct<stage:string,status:string,latency_ms:string,token_input:string,token_output:string,cost_usd:string,citations:array<string>>>"
STEPS = "array<struct<step:string,status:string>>"
NODE = "array<struct<id:string,type:string,label:string,source_url:string,evidence_snippets:array<string>,metadata:array<string>>>"
PAYLOAD = f"""run struct<agent_pipeline:{PIPELINE},workflow:{STEPS},review:struct<approved:boolean,issues:array<string>>>, event struct<source_url:string>, graph struct<nodes:{NODE},edges:array<struct<explanation:string>>>,
context struct<source_snapshot:struct<canonical_url:string>,related_candidates:array<struct<snapshot:struct<canonical_url:string,source_url:string>>>>"""
RECORD = "struct<stage:string,status:string,latency_ms:bigint,token_input:bigint,token_output:bigint,cost_usd:double,citations:array<string>,origin:string>"
CONCEPTUAL = ["Entity", "Evidence", "Rule", "Hypothesis"]


def _some(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def _held(arr: Column) -> Column:
    return F.coalesce(F.size(arr), F.lit(0)) > 0


def verifier_counts(nodes: Column, edges: Column) -> dict[str, Column]:
    """What the verifier counts in a graph's arrays of nodes (type, source_url, evidence_snippets, metadata) and edges (explanation)."""
    nodes, edges = (F.coalesce(c, F.array()) for c in (nodes, edges))
    n = lambda arr, f: F.size(F.filter(arr, f)).cast("long")
    bare = lambda x: x["type"].isin(*CONCEPTUAL) & ~_some(x["source_url"]) & ~_held(x["evidence_snippets"]) & ~_held(x["metadata"])
    return {
        "source_backed": n(nodes, lambda x: _some(x["source_url"])), "evidence_backed": n(nodes, lambda x: _held(x["evidence_snippets"])),
        "unsupported": n(nodes, lambda x: F.coalesce(bare(x), F.lit(False))), "unexplained": n(edges, lambda x: ~_some(x["explanation"])),
    }


def rebuild_traces(runs: DataFrame, traces: DataFrame, overwrite: bool = False) -> DataFrame:
    """Records of the required stages that a run has no trace of (of all with overwrite), from its payload, workflow log and legacy traces.

    runs: run_id, source_url, mode, payload and workflow_log (JSON texts, null or broken ones count as empty). traces: run_id, stage, status, latency_ms,
    token_input, token_output, cost_usd, citations, trace_id. A stage's record in the payload stands, of several the last. Others are rebuilt: planner and
    retriever from the source and the related markets (of the context, else of the graph); graph_editor from the workflow's
    llm_expansion step, else the legacy trace of that name, else the mode, with that trace's telemetry; critic from the review and the
    llm_review step; verifier from the graph. The payload's workflow goes before the log. A run's stages are columns of its row: the only
    shuffles are those that bring legacy traces and leave out stages that have traces, so that doing it twice adds nothing.
    """
    record = lambda **k: F.struct(*(k.get(f.split(":")[0], F.lit(None)).cast(f.split(":")[1]).alias(f.split(":")[0]) for f in ("stage:string", "status:string", "latency_ms:bigint", "token_input:bigint", "token_output:bigint", "cost_usd:double", "citations:array<string>", "origin:string")))
    p = lambda path: F.col(f"_p.{path}")
    none, urls = F.lit(0), F.array().cast("array<string>")
    old = traces.where(F.col("stage").isin("llm_expansion", "llm_review")).groupBy("run_id", "stage").agg(F.max(F.struct("trace_id", "status", "latency_ms", "token_input", "token_output", "cost_usd", "citations")).alias("t"))
    old = old.groupBy("run_id").agg(*(F.first(F.when(F.col("stage") == k, F.col("t")), ignorenulls=True).alias(f"_{k}") for k in ("llm_expansion", "llm_review")))
    x = runs.select("run_id", "source_url", "mode", F.from_json("payload", PAYLOAD).alias("_p"), F.from_json("workflow_log", STEPS).alias("_log")).join(old, "run_id", "left")
    flow = F.when(_held(p("run.workflow")), p("run.workflow")).otherwise(F.col("_log"))
    x = x.withColumns({"_flow": F.coalesce(flow, F.array().cast(STEPS)), "_nodes": F.coalesce(p("graph.nodes"), F.array().cast(NODE))})
    last = lambda arr, f: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(arr, f), lambda s: F.trim(F.coalesce(s["status"], F.lit(""))))), -1)
    said = {k: F.nullif(last(F.col("_flow"), lambda s: F.trim(s["step"]) == k), F.lit("")) for k in ("llm_expansion", "llm_review")}  # noqa: B023

    home = F.coalesce(F.nullif(p("context.source_snapshot.canonical_url"), F.lit("")), F.col("source_url"), F.lit(""))
    named = F.transform(F.coalesce(p("context.related_candidates"), F.array()), lambda c: F.coalesce(F.nullif(c["snapshot"]["canonical_url"], F.lit("")), c["snapshot"]["source_url"], F.lit("")))
    source = F.coalesce(F.nullif(p("event.source_url"), F.lit("")), F.col("source_url"), F.lit(""))
    drawn = F.filter(F.transform(F.filter("_nodes", lambda n: n["type"] == "RelatedMarket"), lambda n: F.trim(F.coalesce(n["source_url"], F.lit("")))), lambda u: u != source)
    related = F.array_distinct(F.filter(F.concat(F.array(home), F.when(_held(named), named).otherwise(drawn)), lambda u: (u != "") | (u == home)))
    cited = F.slice(F.array_distinct(F.filter(F.transform("_nodes", lambda n: F.trim(F.coalesce(n["source_url"], F.lit("")))), lambda u: u != "")), 1, 8)
    counts = verifier_counts(F.col("_nodes"), p("graph.edges"))
    spent = lambda t: {k: F.coalesce(F.col(f"_{t}.{k}"), none) for k in ("latency_ms", "token_input", "token_output", "cost_usd")}
    own = F.filter(F.coalesce(F.col("_llm_expansion.citations"), urls), _some)
    edited = F.coalesce(said["llm_expansion"], F.col("_llm_expansion.status"), F.when(F.col("mode") == "agent-enriched", "completed").otherwise("skipped"))
    judged = p("run.review").isNotNull() & (p("run.review.approved").isNotNull() | p("run.review.issues").isNotNull())
    critic = F.when(~judged, "skipped").otherwise(F.coalesce(said["llm_review"], F.when(p("run.review.approved"), "completed").otherwise("fallback")))
    paid = {k: F.when(judged, c).otherwise(none) for k, c in spent("llm_review").items()}
    free = {k: none for k in ("latency_ms", "token_input", "token_output", "cost_usd")}
    rebuilt = {
        "planner": record(stage=F.lit("planner"), status=F.lit("completed"), citations=F.array(home), **free),
        "retriever": record(stage=F.lit("retriever"), status=F.when(F.size(related) > 1, "completed").otherwise("fallback"), citations=related, **free),
        "graph_editor": record(stage=F.lit("graph_editor"), status=edited, citations=F.slice(F.when(_held(own), own).otherwise(cited), 1, 8), **spent("llm_expansion")),
        "verifier": record(stage=F.lit("verifier"), status=F.when((counts["unsupported"] == 0) & (counts["unexplained"] == 0), "completed").otherwise("fallback"), citations=cited, **free),
        "critic": record(stage=F.lit("critic"), status=critic, citations=urls, **paid),
    }
    num = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    kept_ = lambda r: record(stage=F.trim(r["stage"]), status=F.coalesce(F.nullif(r["status"], F.lit("")), F.lit("completed")), **{k: num(r[k]) for k in free}, citations=F.filter(F.coalesce(r["citations"], urls), _some), origin=F.lit("payload"))
    pipeline = F.coalesce(p("run.agent_pipeline"), F.array().cast(PIPELINE))
    in_payload = {s: F.element_at(F.concat(F.array(F.lit(None).cast(RECORD)), F.transform(F.filter(pipeline, lambda r: F.trim(r["stage"]) == s), kept_)), -1) for s in STAGES}  # noqa: B023
    rows = F.array(*(F.coalesce(in_payload[s], rebuilt[s].withField("origin", F.lit("rebuilt"))) for s in STAGES))
    out = x.select("run_id", F.explode(rows).alias("r")).select("run_id", "r.*")
    return out if overwrite else out.join(traces.select("run_id", "stage").distinct(), ["run_id", "stage"], "left_anti")


def repair_traces(traces: DataFrame) -> DataFrame:
    """cost_usd estimated where tokens were used and none is there; execution mode and provider told by the model's name."""
    paid = F.coalesce("model", F.lit("")).rlike("(?i)claude")
    cost = F.when((F.col("cost_usd") == 0) & (F.col("token_input") + F.col("token_output") > 0), trace_cost(F.col("model"), F.col("token_input"), F.col("token_output"))).otherwise(F.col("cost_usd"))
    return traces.withColumns({"cost_usd": cost, "provider": F.when(paid, "anthropic").otherwise("deterministic"), "execution_mode": F.when(paid, "llm").otherwise("rules")})
