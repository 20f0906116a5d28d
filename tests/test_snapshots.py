"""Snapshot collection in any order of batches, with replays."""

import itertools
import random

import pytest

from marketlens.streaming import snapshots as sn

DDL = "event_slug string, ts_us long, snapshot_id long, status string, p double, markets array<struct<outcomes:array<string>,outcome_prices:array<double>>>"


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = rng.choice([0.2, 0.5, 0.995, 1.0])
        rows.append((f"e{rng.randint(0, 6)}", rng.randint(0, 3), i, rng.choice(["open", "closed"]), p, [(["Yes", "No"], [p, 1 - p])]))
    return rows


def newest(rows):
    return sorted((r[0], r[1], r[2], r[4]) for r in {(r[0], r[1]): r for r in sorted(rows, key=lambda r: r[2])}.values())


def state(spark, folder, schema):
    return sorted((r.event_slug, r.ts_us, r.snapshot_id, r.p) for r in sn.collected_snapshots(spark, folder, schema).collect())


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_any_order(spark, tmp_path, order):
    rows = made(1)
    parts = [rows[:25], rows[25:30], rows[30:]]
    df = spark.createDataFrame(rows, DDL)
    out = f"file://{tmp_path}/store"
    for n, k in enumerate(order):
        sn.merge_snapshots(spark.createDataFrame(parts[k], DDL), n, out, buckets=3)
    assert state(spark, out, df.schema) == newest(rows)
    sn.merge_snapshots(spark.createDataFrame(parts[order[0]], DDL), 0, out, buckets=3)  # a replay that was done
    sn.merge_snapshots(spark.createDataFrame(parts[order[1]], DDL), 3, out, buckets=3)  # the same rows once more
    assert state(spark, out, df.schema) == newest(rows)
    reports = sorted(sn.collection_reports(spark, out).collect())
    assert [r.batch for r in reports] == [0, 1, 2, 3] and sum(r.created for r in reports) == len(newest(rows))
    last = reports[-1]
    assert (last.created, last.updated, last.labelled) == (0, 0, 0) and last.skipped == len({(r[0], r[1]) for r in parts[order[1]]})


def test_reports(spark, tmp_path):
    out, half, won = f"file://{tmp_path}/store", [(["Yes", "No"], [0.5, 0.5])], [(["Yes", "No"], [1.0, 0.0])]
    merge = lambda n, *rows: sn.merge_snapshots(spark.createDataFrame(list(rows), DDL), n, out)
    merge(0, ("a", 1, 1, "open", 0.5, half), ("b", 1, 2, "open", 0.5, half), (None, 1, 9, "open", 0.5, half), ("c", None, 9, "open", 0.5, half))
    merge(1, ("a", 2, 4, "closed", 1.0, won), ("a", 2, 3, "open", 0.5, half), ("b", 1, 5, "open", 0.5, half))
    merge(2, ("b", 1, 4, "open", 0.9, half), ("b", 1, 6, "open", 0.7, None))
    merge(3, ("b", 1, 6, "open", 0.7, None))
    got = [tuple(r) for r in sorted(sn.collection_reports(spark, out).collect())]
    assert got == [(0, 2, 0, 0, 0), (1, 1, 0, 1, 2), (2, 0, 1, 0, 0), (3, 0, 0, 1, 0)]
    # What was skipped as equal still keeps rows that are older than it away.
    assert state(spark, out, spark.createDataFrame([], DDL).schema) == [("a", 1, 1, 0.5), ("a", 2, 4, 1.0), ("b", 1, 6, 0.7)]


def test_broken_attempt_and_stream(spark, tmp_path):
    rows, out, src = made(2), f"file://{tmp_path}/store", f"file://{tmp_path}/in"
    df = spark.createDataFrame(rows, DDL)
    # An attempt at batch 0 that was broken off before its report counts for nothing and is overwritten.
    df.selectExpr("event_slug", "ts_us", "snapshot_id + 1000 as snapshot_id", "status", "p + 1 as p", "markets", "0 as bucket").write.partitionBy("bucket").parquet(f"{out}/changes/batch=0")
    assert state(spark, out, df.schema) == []
    df.repartition(4).write.parquet(src)
    run = lambda at: sn.collect_snapshots(spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(src), out, f"{tmp_path}/{at}", available_now=True).awaitTermination()
    run("at")
    assert state(spark, out, df.schema) == newest(rows)
    before = sn.collection_reports(spark, out).count()
    run("other")  # a new checkpoint plays all batches once more, under numbers that were merged
    assert state(spark, out, df.schema) == newest(rows) and sn.collection_reports(spark, out).count() == before
    sn.merge_snapshots(df.where("false"), 99, out)
    assert sn.collection_reports(spark, out).where("batch = 99 and created + updated + skipped = 0").count() == 1
