"""Shards that all have the corpus's mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, write_table


def _bits(n: int, rows_each: int = 20_000, least: int = 8, most: int = 16) -> int:
    """Enough hash bits for buckets of about rows_each rows."""
    return min(most, max(least, ceil(log2(n / rows_each + 1))))


def stratified_shards(docs: DataFrame, n_shards: int = 16, seed: str = "mix-1", stratum: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row of docs into one of n_shards shards, each a sample of the whole in its mixture of strata.

    Rows of a stratum are shuffled by a seeded hash of doc_id and ranked; rank r of n gets the fraction
    (2r - 1) / 2n. All rows, sorted by fraction, are cut into n_shards runs whose lengths differ by one at most.
    Ranks come from hash buckets and running sums of bucket counts, so that no stratum, however large, and no global
    sort meets in one task.

    Returns doc_id, stratum, size (UTF-8 bytes and 1), text_crc32, shard, slot (0.. within the shard).
    Null text counts as empty; a null stratum is a stratum of its own; a null doc_id is shuffled as any other; rows
    that repeat a doc_id are ordered by text checksum and then arbitrarily. An empty table gives no rows.
    """
    n = docs.count()
    bits = _bits(n)
    wide = 1 << bits
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null"))
    mix = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), name.alias("_s"), mix.alias("_h"), body.alias("_text"))
    bucket = F.shiftright("_h", 60 - bits).alias("_b")

    running = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_s", bucket).agg(F.count("*").alias("_n"))
    starts = counts.select("_s", "_b", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_s")).alias("_of"))
    rows = keyed.select("doc_id", "_s", "_h", bucket, (F.octet_length("_text") + 1).cast("long").alias("size"), F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32"))
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "text_crc32"))
    ranked = rows.join(starts, ["_s", "_b"]).withColumn("_twice", 2 * (F.col("_before") + rank) - 1)
    ranked = write_table(
        ranked.select("doc_id", "_s", "size", "text_crc32", (F.col("_twice") / (2 * F.col("_of"))).alias("_f"), F.expr(f"(_twice * {wide}L) div (2 * _of)").alias("_b")),
        "ranked",
    )

    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over the bucket counts: 65,536 rows at most
    starts = ranked.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_f", "_s", "text_crc32", "doc_id"))
    placed = ranked.join(starts, "_b").withColumn("_at", F.col("_before") + rank - 1)
    placed = placed.withColumn("shard", F.expr(f"_at * {n_shards} div {max(n, 1)}").cast("int"))
    return placed.select("doc_id", F.when(F.col("_s") != "null", F.expr("substring(_s, 2)")).alias("stratum"), "size", "text_crc32", "shard", F.expr(f"_at - (shard * {max(n, 1)}L + {n_shards - 1}) div {n_shards}").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stratified_shards(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 in SQL folds over the bytes by the usual table of 256 entries, which SQL makes from the polynomial.
OP9_SQL = """
with recursive bit(i, k, c) as (
  select i, 0, i from range(256) t(i) union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bit where k < 8),
crc as (select list(c order by i) as t from bit where k = 8),
d as (select doc_id, coalesce(text, '') as text, coalesce('=' || source, 'null') as s,
        ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h from documents),
c as (select doc_id, s, h, octet_length(encode(text))::bigint + 1 as size, case when text = '' then 0 else
        xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(text))::bigint), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::bigint)),
          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) end::bigint as crc
      from d, crc),
r as (select *, row_number() over (partition by s order by h, doc_id, crc) as r, count(*) over (partition by s) as n from c),
p as (select *, row_number() over (order by (2 * r - 1) / (2 * n), s, crc, doc_id) - 1 as pos, count(*) over () as total from r)
select doc_id, size, crc as text_crc32, 'rows' as law, (pos * 16 // total)::int as shard,
  pos - ((pos * 16 // total) * total + 15) // 16 as slot, null::int as grown_shard from p
"""
