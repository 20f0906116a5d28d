"""The corpus pipeline: each stage against a plain version on what the one before it kept."""

import os

import corpus_pipeline

from . import brute
from .test_text_operators import plain_components


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, sf_dir)
        path = "file://" + os.path.join(tmp_path, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows, kept = [(r.doc_id, r.text) for r in before.collect()], docs.collect()
        if name != "packing":
            assert docs.columns == columns and all(r.n_chars == len(r.text or "") for r in kept)
        if name == "toxicity":
            assert len(rows) * 0.75 <= len(kept) < len(rows)
        if name == "near_dedup":
            want = {i for i, (_, c) in plain_components(rows, 5, 80).items() if i == c}
            assert {r.doc_id for r in kept} == want
        if name == "substring_dedup":
            repeats, texts = brute.exact_repeats(rows), {r.doc_id: r.text for r in kept}
            assert all(len((texts.get(i) or "").split()) <= len(dict(rows)[i].split()) - len(c) for i, c in repeats.items())
        if name == "secret_scans":
            assert len(kept) == len(rows) and not any("AKIA" in r.text or "password=" in r.text and "password=[SECRET]" not in r.text for r in kept)
        if name == "packing":
            assert {r.doc_id for r in kept} == {i for i, _ in rows}
        seen.append(len(kept))
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[-1]


def test_odd_rows_pass(spark, tmp_path):
    rows = [(1, None, "en", "s", 0, 5), (2, "", None, None, 0, 5), (None, "plain words here", "en", "s", 16, 5), (3, "plain words here", "en", "s", 16, 5), (3, "plain words here", "en", "s", 16, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.select("doc_id").distinct().count() >= 3
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
