"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, write_table

# Insults of English, German, French and Spanish that hold without any training, and second-person words.
INSULTS = frozenset("""
idiot idiots stupid moron morons loser losers pathetic scum worthless trash clown clowns disgusting dumb imbecile jerk garbage
dummkopf trottel arschloch abschaum widerlich imbécile débile ordure minable estúpido estúpida imbécil basura asqueroso
""".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton tes vous votre tú ti usted ustedes vosotros".split())

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"\b(?=\w*[^\W\d_])(?:[^\W_]*[^\W\d_][0-9@$*!]+[^\W\d_][\w@$*!]*|(?:[^\W\d_][.\-*_ ]){3,}[^\W\d_])\b")
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None, " ": None})
PUNCT = re.compile(r"[!?.,;:]")
CAPS = re.compile(r"[^\W\d_a-zß-öø-ÿ]")


def forms(word: str) -> list[str]:
    """What a lexicon may know of a lower-case word: itself if short, and its first four to seven letters."""
    n = len(word)
    return ([f"={word}"] if n <= 6 else []) + [word[:k] for k in (4, 5, 6, 7) if n > k]


def text_forms(text: str) -> set[str]:
    """Forms of all words of a lower-case text; those of two words or more also with a mark of their own, "2:"."""
    count = Counter(f for w in WORD.findall(text) for f in forms(w))
    return count.keys() | {f"2:{f}" for f, n in count.items() if n > 1}


def dense_features(text: str, weights: dict[str, float], known: dict[str, tuple]) -> list[float]:
    """Lexicon densities, second-person proximity, capitals, punctuation and obfuscation of a whole text.

    weights: of a learned lexicon's forms; known: what weights say of words met before, filled by this function.
    """
    low = text.lower()
    found = WORD.findall(low)
    n = max(len(found), 1)

    def look(w: str) -> tuple:
        x = known.get(w)
        if x is None:
            own = forms(w)
            x = max((weights.get(f, 0.0) for f in own), default=0.0), tuple(k for f in own if (k := f"2:{f}") in weights)
            if len(known) < 50_000:
                known[w] = x
        return x

    count = Counter(found)
    seen = {w: look(w) for w in count}
    hit = {w: x for w, (x, _) in seen.items() if x > 0}
    again = Counter()
    for w, (_, keys) in seen.items():
        for k in keys:
            again[k] += count[w]
    again = {k: m for k, m in again.items() if m > 1}
    at = [i for i, w in enumerate(found) if w in hit] if hit else []
    seeds = sum(w in INSULTS for w in found)
    you = sum(w in SECOND for w in found)
    close = sum(any(w in SECOND for w in found[max(0, i - 5) : i + 6]) for i in at)
    places = np.array(at, dtype=np.int64)
    dense = (np.searchsorted(places, places + 20) - np.arange(len(places))).max(initial=0)
    masked = MASKED.findall(low)
    unmasked = [m.translate(PLAIN) for m in masked]
    letters = max(sum(map(len, found)), 1)
    caps = len(CAPS.findall(text))
    return [
        log1p(len(found)), len(at) / n, log1p(len(at)), log1p(len(hit)), sum(hit[found[i]] for i in at) / n, max(hit.values(), default=0.0), seeds / n, log1p(seeds),
        you / n, close / max(len(at), 1), log1p(close), float(dense), caps / letters, len(PUNCT.findall(text)) / n, low.count("!") / n, low.count("?") / n,
        log1p(len(again)), max((weights[k] for k in again), default=0.0), log1p(max(again.values(), default=0)), max(again.values(), default=0) / n,
        len(masked) / n, float(sum(u in INSULTS or look(u)[0] > 0 for u in unmasked)),
    ]


@dataclass
class Toxicity:
    """A fitted model; trees is None where the labels held one class only, and then prior is every score."""

    weights: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    prior: float


def _with_features(docs: DataFrame, weights: dict[str, float], text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def dense(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple] = {}
        for part in parts:
            yield part.map(lambda x: dense_features(x, weights, known))

    return docs.withColumn("_tox_x", dense(F.coalesce(F.col(text), F.lit(""))))


def learn_lexicon(counts: DataFrame, texts: dict[int, int], size: int = 4_000, least: int = 4, ratio: float = 8.0) -> dict[str, float]:
    """Weights (log odds) of the forms that mark toxic texts: in least of them or more, and ratio times as often as in others.

    counts: form, yes and no (in how many toxic and other texts, summed here); texts: how many there are of each label.
    The size forms in most toxic texts come to the driver.
    """
    a, b = texts.get(1, 0) + 1, texts.get(0, 0) + 1
    odds = (F.col("yes") / a) / ((F.col("no") + 0.5) / b)
    totals = counts.groupBy("form").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    top = totals.where((F.col("yes") >= least) & (odds >= ratio)).orderBy(F.desc("yes"), "form").limit(size)
    return {x["form"]: log((x["yes"] / a) / ((x["no"] + 0.5) / b)) for x in top.collect()} | {f"={w}": 6.0 for w in INSULTS if len(w) <= 6} | {w[:6]: 6.0 for w in INSULTS if len(w) > 6}


def form_counts(labelled: DataFrame) -> DataFrame:
    """fold, form, and in how many toxic (yes) and other (no) texts of labelled (text, y, fold) it stands. Tasks add up their own, which the bound on labelled rows keeps small."""
    bounded_batches(labelled.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            for text, y, fold in zip(batch["text"], batch["y"], batch["fold"], strict=True):
                for f in text_forms((text or "").lower()):
                    sums.setdefault((fold, f), [0, 0])[0 if y else 1] += 1
        yield pd.DataFrame([(fold, f, yes, no) for (fold, f), (yes, no) in sums.items()], columns=["fold", "form", "yes", "no"])

    rows = labelled.select("text", "y", "fold").mapInPandas(count, "fold int, form string, yes long, no long")
    return rows.groupBy("fold", "form").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).where("yes > 0")


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 45_000, text: str = "text", doc_id: str = "doc_id", trees: int = 20, depth: int = 3) -> Toxicity:
    """Learns from labels (doc_id, toxic) of rows whose crc32(doc_id as text) mod 3 is not 1.

    About max_labelled of them are used, chosen by a hash, in two folds (remainders 0 and 2). The features of a fold's
    texts are taken with the other fold's lexicon, so that trees never see a word weighted by a text's own label; each
    fold is scored by trees of the other, and isotonic calibration learns from these scores. The lexicon and the trees
    that are kept learn from both folds. A fold with one class only scores the other by the share of toxic texts.
    Labels that are null are left out; of repeated labels the highest counts; null texts are empty. Labels are
    broadcast: their number is bounded by max_labelled.
    """
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("doc_id")).agg(F.max("toxic").alias("y")).where(part != 1)
    n = known.count()
    known = known if n <= max_labelled else known.where(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1_000_000)) < int(1e6 * max_labelled / n))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id").select("text", F.col("y").cast("int").alias("y"), (part == 2).cast("int").alias("fold"))
    rows = write_table(rows, "labelled")
    counts = write_table(form_counts(rows), "forms")
    texts = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    sums = {y: texts.get((0, y), 0) + texts.get((1, y), 0) for y in (0, 1)}
    prior = sums[1] / max(sums[0] + sums[1], 1)
    weights = learn_lexicon(counts, sums)
    if not sums[0] or not sums[1]:
        return Toxicity(weights, None, None, prior)
    per_fold = [learn_lexicon(counts.where(F.col("fold") == f), {y: texts.get((f, y), 0) for y in (0, 1)}) for f in (0, 1)]
    x = [_with_features(rows.where(F.col("fold") == f), per_fold[1 - f], "text").select(array_to_vector("_tox_x").alias("features"), F.col("y").cast("double").alias("label"), "fold") for f in (0, 1)]
    x = write_table(x[0].unionByName(x[1]), "toxicity").coalesce(4)

    def grow(part: DataFrame, toxic: int) -> GBTClassificationModel:
        least = int(min(max(toxic / 10, 2), 50))  # a leaf isn't grown for a few mislabelled rows
        return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, seed=5, checkpointInterval=-1, minInstancesPerNode=least).fit(part)

    out = []
    for f in (0, 1):
        mine, other = x.where(F.col("fold") == f), x.where(F.col("fold") == 1 - f)
        if texts.get((f, 0)) and texts.get((f, 1)):
            scored = grow(mine, texts[f, 1]).transform(other).select(F.get(vector_to_array("probability"), F.lit(1)).alias("p"), "label")
        else:
            scored = other.select(F.lit(float(prior)).alias("p"), "label")
        out.append(scored)
    curve = IsotonicRegression(featuresCol="p", labelCol="label").fit(write_table(out[0].unionByName(out[1]), "scores"))
    return Toxicity(weights, grow(x, sums[1]), curve, prior)


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", threshold: float = 0.7, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with score and predicted (1 where score >= threshold); columns of the names given for these are replaced.

    score is the calibrated probability, with a thousandth of the trees' own, which orders rows that calibration puts on
    one step. Null texts are scored as empty ones; repeated texts get equal scores.
    """
    docs = docs.drop(score, predicted)
    if model.trees is None:
        scored = docs.withColumn(score, F.lit(float(model.prior)))
    else:
        own = docs.columns
        x = _with_features(docs, model.weights, text).withColumn("_tox_v", array_to_vector("_tox_x"))
        trees = model.trees.copy().setFeaturesCol("_tox_v").setRawPredictionCol("_tox_raw").setProbabilityCol("_tox_prob").setPredictionCol("_tox_y")
        x = trees.transform(x).withColumn("_tox_p", F.get(vector_to_array("_tox_prob"), F.lit(1)))
        x = model.curve.copy().setFeaturesCol("_tox_p").setPredictionCol("_tox_c").transform(x)
        scored = x.withColumn(score, F.least(F.greatest(F.col("_tox_c") * 0.999 + F.col("_tox_p") * 0.001, F.lit(0.0)), F.lit(1.0))).select(*own, score)
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
