"""Folders for tables that a call writes and reads back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions that name none.
_own: dict[str, str] = {}
#: Folders named so far, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one where unset (local use)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        root = _own[app]
    return root.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/marketlens/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def mark() -> int:
    """How many folders were named so far: where drop() may begin."""
    return len(_made)


def drop(spark: SparkSession, since: int, *keep: str) -> None:
    """Deletes the folders named since a mark, but for keep: for callers that have written what was made of them."""
    delete(spark, [x for x in _made[since:] if x not in keep])
    _made[since:] = [x for x in _made[since:] if x in keep]


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes folders that new_dir named; a folder that is gone already is passed over."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def kept(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df written (with options of the Parquet writer) to a folder of its own and read back, so that what made it runs once."""
    out = new_dir(df.sparkSession, label)
    df.write.options(**options).parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


@contextmanager
def freeing_shuffles(spark: SparkSession):
    """What runs inside deletes its shuffle files as soon as it has ended, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settled(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as kept, with what was shuffled for it deleted at once: for steps whose shuffle files would add up on disk."""
    with freeing_shuffles(df.sparkSession):
        return kept(df, label, **options)
