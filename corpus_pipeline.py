"""A corpus pipeline over documents: toxicity, near duplicates, repeated passages, secrets, packing.

Each stage works on all rows that the one before it kept, and hands on documents with the columns it was given; n_chars
follows the text where a stage changes it. The last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import neardup, packing, passages, secrets, toxicity


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels), score="_tox_score", predicted="_tox_predicted")
    return scored.where("_tox_predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more; of repeated rows, one."""
    marks = neardup.near_duplicates(docs, size=5, percent=80).where("kept").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    rows = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = rows.join(marks, (F.col("_hash") == F.col("_tie")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier one has; those that hold nothing else go."""
    return _sized(passages.drop_passages(docs, passages.repeated_passages(docs)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with [SECRET] for the values of secrets."""
    return _sized(secrets.redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024, 512, 256 and 128 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: SQL can't fit the models of the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage wrote on its way is deleted once its own result is written."""
    from marketlens import scratch

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = scratch.mark()
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path, schema = scratch.new_dir(spark, f"stage-{name}"), docs.schema
            docs.write.parquet(path)
            docs = spark.read.schema(schema).parquet(path)
            scratch.drop(spark, since, path)
    return docs
