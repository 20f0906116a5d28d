"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete, freeing_shuffles, kept, new_dir, settled, shared_dir  # noqa: F401
from ..shipping import ready

#: The six ASCII white-space characters that separate words.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def write_table(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet (with options of the writer) into the shared folder and reads it back with the same schema."""
    return settled(df, label, **options)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables of write_table that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, {f.rsplit("/", 1)[0] for f in t.inputFiles()})


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Keeps Arrow batches for Python workers small whatever the length of the texts, and gives workers this package."""
    ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def bind(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it and wherever the optimizer moves the whole."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; an empty array for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES, -1))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> bool:
    """Whether df has at most max_rows rows and about max_bytes: the size check before a broadcast."""

    def width(name: str, kind) -> Column:
        if kind.typeName() == "array":
            return F.coalesce(F.size(name), F.lit(0)) * 8 * len(getattr(kind.elementType, "fields", [0]))
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16 if kind.typeName() in ("string", "binary") else F.lit(16 * max(len(getattr(kind, "fields", [])), 1))

    total = F.lit(0)
    for f in df.schema.fields:
        total = total + width(f.name, f.dataType)
    seen = df.agg(F.count("*").alias("n"), F.sum(total.cast("long")).alias("size")).first()
    return seen["n"] <= max_rows and (seen["size"] or 0) <= max_bytes


def semi_by_size(df: DataFrame, keys: DataFrame, on: list[str], max_rows: int = 2_000_000) -> DataFrame:
    """Rows of df whose key is in keys. A key table of at most max_rows rows is broadcast, so that df isn't shuffled; a larger one is joined by a shuffle."""
    side = F.broadcast(keys) if small(keys, max_rows) else keys
    return df.join(side, on, "left_semi")
