"""Quality rules as a short-circuit cascade whose order comes from measured cost and selectivity."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, read, words, write_table


@dataclass(frozen=True)
class Rule:
    """A name, and a condition that is true for rows to reject (null counts as false)."""

    name: str
    reject: Column


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text to docs.

    Null text has no words, and all its counts are 0. Work columns begin with an underscore and two letters "ml".
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_ml_words", words(F.col(text)))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumns(
        {
            "n_words": F.size("_ml_words").cast("long"),
            "word_chars": F.length(F.array_join("_ml_words", "")).cast("long"),
            "n_symbols": F.size(F.regexp_extract_all(body, F.lit("[#*$%&|<>]"), F.lit(0))).cast("long"),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_ml_words")).cast("long"),
        }
    ).drop("_ml_words")


def _repeat_words(array: Column) -> Column:
    """How many words stand in 3-word windows found twice or more."""

    def count(w: Column) -> Column:
        triples, at = F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.get(w, i)
        window = lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("w"), i.alias("i"))
        # Windows with all different hashes are all different; only texts with an equal pair have their windows sorted.
        repeats = bind(F.transform(triples, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) < 4, F.lit(0)).when(repeats, bind(F.array_sort(F.transform(triples, window)), covered)).otherwise(F.lit(0))

    def covered(s: Column) -> Column:
        beside = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
        twice = F.filter(s, lambda x, k: beside(x, k - 1) | beside(x, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return bind(array, count)


def standard_rules(text: str = "text") -> list[Rule]:
    """Rules over a text and its base_metrics; each is cheap beside the metrics and none needs a language."""
    body = F.coalesce(F.col(text), F.lit(""))
    share = lambda pattern: F.size(F.regexp_extract_all(body, F.lit(pattern), F.lit(0))) / F.greatest(F.length(body), F.lit(1))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("capitals", share("[A-Z]") > 0.3),
        Rule("exclamation", F.size(F.regexp_extract_all(body, F.lit("!"), F.lit(0))) * 10 > F.col("n_words") * 3),
        Rule("digits", share("[0-9]") > 0.3),
        Rule("word_length", (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 15)),
        Rule("dup_lines", F.col("n_dup_lines") * 2 > F.size(F.split(body, "\n", -1))),
    ]


def plan_cascade(part: DataFrame, rules: list[Rule]) -> list[dict]:
    """Orders rules by rows rejected per second, both estimated on part, a sample kept as a table.

    The cost of a rule is the time of a scan of the sample that evaluates it, less that of one that doesn't; what a
    rule rejects counts among rows that the rules before it let through. The order changes speed, never the verdict.
    An empty sample leaves the rules in the order given.
    """

    def seconds(*cols: Column) -> float:
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            part.agg(F.count("*"), *(F.count_if(c) for c in cols)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    idle = seconds()
    cost = {r.name: max(seconds(r.reject) - idle, 1e-4) for r in rules}
    bits = [F.coalesce(r.reject, F.lit(False)).cast("int").alias(r.name) for r in rules]
    seen = part.select(*bits).groupBy(*(r.name for r in rules)).count().collect()  # at most 2 ** rules rows
    left, order = [(x.asDict(), x["count"]) for x in seen], []
    rest = list(rules)
    while rest:
        hits = {r.name: sum(k for x, k in left if x[r.name]) for r in rest}
        best = max(rest, key=lambda r: hits[r.name] / cost[r.name])
        order.append({"rule": best, "name": best.name, "seconds": cost[best.name], "rejected": hits[best.name], "seen": sum(k for _, k in left)})
        left = [(x, k) for x, k in left if not x[best.name]]
        rest.remove(best)
    return order


def verdict(order: list[dict]) -> Column:
    """True for rows that no rule rejects; a row that one rejects isn't shown to the next."""
    out = F.lit(True)
    for step in reversed(order):
        out = F.when(step["rule"].reject, F.lit(False)).otherwise(out)
    return out


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", key: str = "doc_id", sample_rows: int = 2_000) -> DataFrame:
    """docs with base_metrics, base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: base_failed is
    false and the cascade, planned on about sample_rows rows, rejects nothing. Null and empty texts fail the base. Columns of docs with the names of
    metrics are replaced. An empty table gives no rows; repeated rows are judged one by one.
    """
    rules = rules or standard_rules(text)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    n = docs.count()
    part = docs if n <= sample_rows else docs.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_000)) < int(1e6 * sample_rows / n))
    order = plan_cascade(write_table(base_metrics(part, text), "sample").where(~failed), rules)
    return base_metrics(docs, text).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(order)))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(read(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


OP3_SQL = r"""
with a as (select doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
b as (select doc_id, text, w, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    length(text) as n from a),
t as (select doc_id, unnest(range(n_words - 2)) as i, w from b where n_words > 2),
k as (select doc_id, i, count(*) over (partition by doc_id, w[i + 1], w[i + 2], w[i + 3]) as c from t),
r as (select doc_id, count(distinct j)::bigint as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from k where c > 1) group by doc_id),
m as (select b.*, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from b left join r using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (n_symbols * 10 > n_words or len(regexp_extract_all(text, '[A-Z]')) / greatest(n, 1) > 0.3
    or len(regexp_extract_all(text, '!')) * 10 > n_words * 3 or len(regexp_extract_all(text, '[0-9]')) / greatest(n, 1) > 0.3
    or word_chars < n_words * 2 or word_chars > n_words * 15 or n_dup_lines * 2 > len(string_split(text, chr(10)))) as kept
from f
"""
