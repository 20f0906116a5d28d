"""Continuous collection of snapshots: batches merged once each, the newest version of a snapshot winning in whatever order they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.forecast import decisive

KEYS, VERSION = ["event_slug", "ts_us"], "snapshot_id"
REPORT = "batch long, created long, updated long, skipped long, labelled long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def collection_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each merged batch: snapshots created, updated and skipped, and those that got a label by it."""
    path = f"{folder}/reports"
    return spark.read.schema(REPORT).option("recursiveFileLookup", "true").parquet(path) if _exists(spark, path) else spark.createDataFrame([], REPORT)


def collected_snapshots(spark: SparkSession, folder: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """The snapshots merged so far, a row for each slug and time; of some buckets of slugs where given.

    The store is a log of changed rows by batch and bucket; the row of the largest snapshot_id (of equal ones the larger
    row) stands. Batches without a report were broken off and don't count.
    """
    if not _exists(spark, f"{folder}/changes"):
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    log = spark.read.schema(whole).parquet(f"{folder}/changes")
    log = log.where(F.col("bucket").isin(buckets)) if buckets is not None else log
    log = log.join(F.broadcast(collection_reports(spark, folder).select("batch")), "batch", "left_semi")  # a row for each batch
    return _newest(log, schema.names)


def _newest(rows: DataFrame, columns: list[str]) -> DataFrame:
    rest = [c for c in columns if c not in KEYS]
    best = rows.groupBy(*KEYS).agg(F.max(F.struct(VERSION, F.struct(*rest).alias("v"))).alias("m"))
    return best.select(*KEYS, "m.v.*").select(*columns)


def merge_snapshots(batch: DataFrame, n: int, folder: str, buckets: int = 64, threshold: float = 0.99) -> None:
    """Merges batch number n into the store in folder, unless that was done before: a replay adds nothing.

    batch: event_slug, ts_us, snapshot_id (which grows with each collection) and more, all of which can be ordered; rows without a slug or time
    are left out. The largest snapshot_id of a slug and time wins, in the batch and against the store, so that the
    result doesn't depend on the order of batches. A row is created, updated, or skipped where it is older or says what is there
    (then only its snapshot_id is kept). With status and markets, labelled counts the snapshots whose slug is
    decided by what came. Only the batch's buckets of slugs are read. Changes are written first, the report last; both
    overwrite what a broken attempt has left, and without its report a batch doesn't count.
    """
    spark = batch.sparkSession
    if _exists(spark, f"{folder}/reports/batch-{n}/_SUCCESS"):
        return
    columns = batch.columns
    bucket = F.pmod(F.xxhash64("event_slug"), F.lit(buckets)).cast("int")
    came = _newest(batch.where(F.col("event_slug").isNotNull() & F.col("ts_us").isNotNull() & F.col(VERSION).isNotNull()), columns).persist()
    try:
        touched = [r[0] for r in came.select(bucket).distinct().collect()]  # as many as buckets at most
        known = collected_snapshots(spark, folder, batch.schema, touched)
        rest = [c for c in columns if c not in KEYS]
        said = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in rest if c != VERSION))
        both = came.select(*KEYS, F.struct(*rest).alias("new")).join(known.select(*KEYS, F.struct(*rest).alias("old")), KEYS, "left")
        wins = F.col("old").isNull() | (F.struct(F.col(f"new.{VERSION}"), F.col("new")) > F.struct(F.col(f"old.{VERSION}"), F.col("old")))
        kind = F.when(F.col("old").isNull(), "created").when(wins & ~said("new").eqNullSafe(said("old")), "updated").otherwise("skipped")
        judged = both.select(*KEYS, "new", wins.alias("_wins"), kind.alias("_kind")).persist()
        try:
            judged.where("_wins").select(*KEYS, "new.*").select(*columns, bucket.alias("bucket")).write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/changes/batch={n}")
            counts = judged.agg(*(F.count_if(F.col("_kind") == k).alias(k) for k in ("created", "updated", "skipped"))).first()
            labelled = 0
            if {"status", "markets"} <= set(columns):
                before = known.join(came.select("event_slug").distinct(), "event_slug", "left_semi")
                decided = lambda rows: rows.join(decisive(rows, threshold).select("event_slug"), "event_slug").select(*KEYS)
                labelled = decided(_newest(before.unionByName(came), columns)).join(decided(before), KEYS, "left_anti").count()
        finally:
            judged.unpersist()
    finally:
        came.unpersist()
    spark.createDataFrame([(n, counts.created, counts.updated, counts.skipped, labelled)], REPORT).coalesce(1).write.mode("overwrite").parquet(f"{folder}/reports/batch-{n}")


def collect_snapshots(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = False, buckets: int = 64, threshold: float = 0.99):
    """Starts a query that merges each batch of snapshots into the store in folder, a report for each."""
    out = stream.writeStream.foreachBatch(lambda batch, n: merge_snapshots(batch, n, folder, buckets, threshold)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
