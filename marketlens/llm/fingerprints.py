"""SpotSigs: chains of content words after common-word anchors as a document's signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind, read, small, write_table

#: Common words of English, German, French and Spanish.
ANCHORS = """
the of and to in a is that it was for on are as with his they at be this from have or by not but what all were when
der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
le la les et un une du que qui dans pour pas au sur ne se ce il sont avec son plus par est nous
el los las de y en por con para del al lo su como más pero sus o si sobre entre cuando muy sin ser
""".split()


def signatures(text: Column, chain: int = 2) -> Column:
    """The distinct signatures of a text as a sorted array<string>.

    A signature is the first eight hex digits of the MD5 of an anchor and the next chain content words; anchors and content words are lower-case
    runs of letters and digits. Anchors near the end take what content words there are, one at least. A text without
    any signature of this kind takes every word as an anchor and the words after it as its chain, so that texts without
    common words can be compared too. Null, empty and wordless texts have none.
    """
    stop = [F.lit(x) for x in dict.fromkeys(ANCHORS)]
    spot = lambda anchor, content, i: F.left(F.md5(F.concat_ws(" ", anchor, *(F.get(content, i + k) for k in range(chain)))), F.lit(8))

    def spots(w: Column) -> Column:
        def chains(content: Column) -> Column:
            # The j-th anchor at word i has i - j content words before it.
            anchors = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*stop), i)), lambda i: i.isNotNull())
            found = F.transform(anchors, lambda i, j: F.when(F.get(content, i - j).isNotNull(), spot(F.get(w, i), content, i - j)))
            return F.filter(found, lambda x: x.isNotNull())

        return bind(F.filter(w, lambda x: ~x.isin(*stop)), chains)

    def of(w: Column) -> Column:
        plain = F.transform(w, lambda x, i: spot(x, w, i + 1))
        return bind(spots(w), lambda s: F.sort_array(F.array_distinct(F.when(F.size(s) > 0, s).otherwise(plain))))

    pieces = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return bind(F.filter(pieces, lambda x: x != ""), of)


def fingerprint(sigs: Column) -> Column:
    """Signatures as text: eight hex digits each, in order. Equal texts have equal fingerprints."""
    return F.array_join(sigs, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of signatures: 1 for two empty ones."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b)
    return F.when(union == 0, F.lit(1.0)).otherwise(bind(inter, lambda x: x / (union - x)))


def with_next(docs: DataFrame, run_bytes: int = 4 << 20, quantiles: int = 64) -> DataFrame:
    """Adds sigs, and next_text and next_sigs: those of the row that follows by descending doc_id, and for the last row of the first.

    docs has doc_id (an integer) and text; only these are shuffled. Rows are dealt into runs of ids of about run_bytes of text, eight or so to a
    task: by quantiles, within them by equal steps, rows without an id, which come last, by the hash of their text. Each run is given the first
    row of the run after it as a guest, so that a window over a run finds every row's follower. Only the quantiles reach
    the driver; the table of runs has a row for each. Rows that repeat an id follow by the hash of their text.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be an integer")
    none = F.col("doc_id").isNull()
    size = F.octet_length("text").cast("long") + 16
    facts = docs.agg(F.percentile_approx("doc_id", [k / quantiles for k in range(quantiles + 1)], 10_000).alias("q"), F.sum(size).alias("all"), F.sum(F.when(none, size)).alias("bare")).first()
    cuts = sorted({int(x) for x in facts["q"] or [0]}, reverse=True)
    parts = lambda n, of: max(1, -(-(n or 0) // (of * run_bytes)))
    steps, bare = parts((facts["all"] or 0) - (facts["bare"] or 0), len(cuts)), parts(facts["bare"], 1)
    # Cut k holds the ids from cuts[k] down to just above cuts[k + 1]; the last one its own cut.
    array = F.array(*(F.lit(x) for x in cuts)).cast("array<bigint>")
    k = F.greatest(F.size(F.filter(array, lambda x: x >= F.col("doc_id"))) - 1, F.lit(0))
    top, end = F.get(array, k), F.coalesce(F.get(array, k + 1), F.get(array, k) - 1)
    step = F.least(F.floor((top - F.col("doc_id")) / F.greatest(top - end, F.lit(1)) * steps), F.lit(steps - 1))
    share = (F.col("_tie").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    run = F.when(none, len(cuts) * steps + F.least(F.floor(share * bare), F.lit(bare - 1))).otherwise(k * steps + F.greatest(step, F.lit(0)))
    rows = docs.withColumn("_tie", F.xxhash64("text")).withColumn("_run", run.cast("long"))
    heads = rows.groupBy("_run").agg(F.max("doc_id").alias("_id"), F.min(F.when(none, F.col("_tie"))).alias("_t"))
    order = Window.orderBy("_run")  # a row for each run
    heads = write_table(heads, "runs").withColumn("_to", F.coalesce(F.lag("_run").over(order), F.max("_run").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    head = (F.col("doc_id") == F.col("_id")) | (none & (F.col("_tie") == F.col("_t")))
    guests = rows.join(F.broadcast(heads) if small(heads, 1_000_000) else heads, "_run").where(head).withColumn("_run", F.col("_to")).select(rows.columns)
    dealt = rows.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (facts["all"] or 0) // (8 * run_bytes))
    dealt = dealt.repartition(tasks, "_run").withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("_run").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "_tie")
    found = dealt.withColumns({"next_text": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)})
    return found.where("_guest = 0").drop("_run", "_guest", "_tie")


def near_pairs(docs: DataFrame, threshold: float = 0.8, chain: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links between different signature sets of Jaccard similarity threshold or more, and each row's class.

    Returns doc_id, class_id (the smallest doc_id with the same signatures) and n_links (other classes linked). Sets
    meet where they share a signature among the rarest floor((1 - threshold) n) + 1 of each, which is lossless; pairs
    are cut by set length before their sets are compared. Rows without signatures are in one class, without links.
    Equal sets are compared once for all copies; ties in rarity go by signature.
    """
    sets = docs.select(F.col(doc_id).alias("doc_id"), signatures(F.col(text), chain).alias("sigs"))
    members = sets.withColumn("_h", F.xxhash64("sigs"))
    classes = members.groupBy("_h").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs"))
    counts = classes.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    ranked = classes.select("_h", F.size("sigs").alias("n"), F.explode("sigs").alias("sig")).join(counts, "sig")
    rank = F.row_number().over(Window.partitionBy("_h").orderBy("df", "sig"))
    prefix = ranked.withColumn("r", rank).where(F.col("r") <= F.floor((1 - threshold) * F.col("n") + 1e-9) + 1)
    # Partition by set length: a set meets those of its own length class and of the next one only.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold))).cast("int")
    prefix = prefix.select("_h", "n", "sig", step.alias("p"))
    left = prefix.select(F.col("_h").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("p", F.col("p") + 1)).alias("p"))
    right = prefix.select(F.col("_h").alias("b"), F.col("n").alias("nb"), "sig", "p")
    close = (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    pairs = left.join(right, ["sig", "p"]).where(close).select("a", "b").distinct()
    sigs = lambda s: classes.select(F.col("_h").alias(s), F.col("sigs").alias(f"s{s}"))
    links = pairs.join(sigs("a"), "a").join(sigs("b"), "b").where(likeness(F.col("sa"), F.col("sb")) >= threshold).select("a", "b")
    ends = links.select(F.col("a").alias("_h")).unionByName(links.select(F.col("b").alias("_h"))).groupBy("_h").agg(F.count("*").alias("n_links"))
    named = classes.select("_h", "class_id").join(ends, "_h", "left")
    return members.select("doc_id", "_h").join(named, "_h").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (its last half replaced from the next document) and their likeness.

    doc_id is an integer; rows without one follow all others, by a hash of their text. Null text counts as empty; repeated
    rows give a row each; extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows)
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    out = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    out = out.withColumn("edited_sigs", signatures(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))


_ANCHORS = "[" + ", ".join(f"'{x}'" for x in dict.fromkeys(ANCHORS)) + "]"


def _sigs_sql(text: str) -> str:
    spot = lambda a, b, c: f"substr(md5(concat_ws(' ', {a}, {b}, {c})), 1, 8)"
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""(select list_sort(list_distinct(case when len(s) > 0 then s else list_transform(range(len(w)), lambda i: {spot("w[i + 1]", "w[i + 2]", "w[i + 3]")}) end)) from
  (select w, list_filter(list_transform(range(len(p)), lambda j: case when p[j + 1] - j < len(c) then {spot("w[p[j + 1] + 1]", "c[p[j + 1] - j + 1]", "c[p[j + 1] - j + 2]")} end), lambda x: x is not null) as s from
   (select w, list_filter(w, lambda x: not list_contains({_ANCHORS}, x)) as c, list_filter(range(len(w)), lambda i: list_contains({_ANCHORS}, w[i + 1])) as p from (select {words} as w))))"""


OP6_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, t, coalesce(lead(t) over w, first_value(t) over w) as nt from d window w as (order by doc_id desc)),
e as (select doc_id, t, nt, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) as e from n),
s as (select doc_id, length(t)::bigint as n_chars, sha256(e) as edited_sha256, {_sigs_sql("t")} as a, {_sigs_sql("e")} as b, {_sigs_sql("nt")} as c from e)
select doc_id, n_chars, edited_sha256, array_to_string(a, '') as fingerprint, array_to_string(b, '') as edited_fingerprint,
  case when len(a) + len(b) = 0 then 1.0::double else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end as near_edited,
  case when len(a) + len(c) = 0 then 1.0::double else len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c))) end as near_next from s
"""
