"""Snapshots, resolution labels and the forecast backtest."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept
from ..shipping import ready

FEATURES = ["p", "extremeness", "log_volume", "log_liquidity", "log_open_interest", "related", "evidence", "has_related", "has_evidence"]


def terminal_outcome(markets: Column) -> Column:
    """struct<outcome, price> of the highest price among all outcomes of all markets (array<struct<outcomes, outcome_prices>>); the first wins on ties; markets with a price missing are skipped."""
    fit = F.filter(markets, lambda m: F.size(m["outcomes"]) == F.size(m["outcome_prices"]))
    pairs = F.flatten(F.transform(fit, lambda m, i: F.transform(m["outcomes"], lambda o, k: F.struct(F.get(m["outcome_prices"], k).alias("price"), (-i).alias("i"), (-k).alias("k"), o.alias("outcome")))))
    best = F.array_max(pairs)
    return F.struct(best["outcome"].alias("outcome"), best["price"].alias("price"))


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def decisive(snapshots: DataFrame, threshold: float = 0.99) -> DataFrame:
    """event_slug, outcome and price of the newest closed snapshot of each slug whose best outcome reaches threshold."""
    closed = snapshots.where("status = 'closed'").withColumn("_t", terminal_outcome(F.col("markets"))).where(F.col("_t.price") >= threshold)
    best = closed.groupBy("event_slug").agg(F.max(F.struct("ts_us", "snapshot_id", "_t")).alias("b"))
    return best.select("event_slug", F.col("b._t.outcome").alias("outcome"), F.col("b._t.price").alias("price"))


def label_families(snapshots: DataFrame, labels: DataFrame | None = None, threshold: float = 0.99, overwrite: bool = False) -> DataFrame:
    """Labels for all snapshots of decided slugs; those that have one already are left out unless overwrite."""
    found = snapshots.select("snapshot_id", "event_slug").join(decisive(snapshots, threshold), "event_slug")
    if labels is not None and not overwrite:
        found = found.join(labels.select("snapshot_id"), "snapshot_id", "left_anti")
    return found.select("snapshot_id", "event_slug", F.col("outcome").alias("resolved_outcome"), F.col("price").alias("resolved_probability"), F.lit("terminal").alias("source"))


def propagate_labels(snapshots: DataFrame, labels: DataFrame) -> DataFrame:
    """The newest label of a slug for its snapshots that have none. labels: snapshot_id, event_slug, resolved_outcome, resolved_probability, created_us."""
    newest = labels.groupBy("event_slug").agg(F.max(F.struct("created_us", "snapshot_id", "resolved_outcome", "resolved_probability")).alias("b"))
    bare = snapshots.select("snapshot_id", "event_slug").join(labels.select("snapshot_id"), "snapshot_id", "left_anti")
    return bare.join(newest, "event_slug").select("snapshot_id", "event_slug", "b.resolved_outcome", "b.resolved_probability", F.lit("propagated").alias("source"))


def backfill_labels(snapshots: DataFrame, labels: DataFrame, refreshed: DataFrame | None = None, threshold: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Labels for unlabelled snapshots, from the slug's newest label or else its closed decisive snapshot (refreshed ones count too); and one row of counts."""
    prior = labels.groupBy("event_slug").agg(F.max(F.struct("created_us", "snapshot_id", "resolved_outcome")).alias("b")).select("event_slug", F.col("b.resolved_outcome").alias("known"))
    pool = snapshots if refreshed is None else snapshots.unionByName(refreshed)
    final = decisive(pool, threshold).select("event_slug", F.col("outcome").alias("decided"))
    bare = snapshots.select("snapshot_id", "event_slug").join(labels.select("snapshot_id"), "snapshot_id", "left_anti").join(prior, "event_slug", "left").join(final, "event_slug", "left")
    source = F.when(F.col("known").isNotNull(), "propagated").when(F.col("decided").isNotNull(), "terminal").otherwise("unresolved")
    out = bare.select("snapshot_id", "event_slug", F.coalesce("known", "decided").alias("resolved_outcome"), source.alias("source"))
    report = out.agg(F.countDistinct("event_slug").alias("slugs"), *(F.count_if(F.col("source") == s).alias(s) for s in ("propagated", "terminal", "unresolved")))
    return out.where("source <> 'unresolved'"), report


def upsert_latest(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """target with updates applied by key, the last by order of several winning; and one row counting created, updated and skipped (equal) ones.

    One shuffle by key of both sides. Columns are those of target; a null-safe comparison of all of them decides what changed. Where
    order is one of them, a row of target that is newer by it stays, and the update is skipped.
    """
    cols = target.columns
    rest = [c for c in cols if c not in keys]
    last = updates.groupBy(*keys).agg(F.max(F.struct(order, F.struct(*rest).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias("new"))
    both = target.select(*keys, F.struct(*rest).alias("old")).join(last, keys, "full_outer")
    older = F.col(f"new.{order}") < F.col(f"old.{order}") if order in rest else F.lit(False)
    same = F.col("old").eqNullSafe(F.col("new")) | older
    kind = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "created").when(same, "skipped").otherwise("updated")
    both = both.withColumn("_kind", kind)
    rows = both.select(*keys, F.when(F.col("_kind") == "skipped", F.col("old")).otherwise(F.coalesce("new", "old")).alias("v")).select(*keys, "v.*").select(*cols)
    return rows, both.agg(*(F.count_if(F.col("_kind") == k).alias(k) for k in ("created", "updated", "skipped")))


def upsert_snapshots(target: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    return upsert_latest(target, batch, ["event_slug", "ts_us"], "snapshot_id")


def snapshot_features(snapshots: DataFrame, p: str = "p") -> DataFrame:
    """The nine features of each snapshot, beside its columns."""
    bounded = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    log = lambda c: F.log1p(F.coalesce(c, F.lit(0.0)))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return snapshots.withColumns({
        "p": bounded, "extremeness": F.abs(bounded - 0.5), "log_volume": log(F.col("volume")), "log_liquidity": log(F.col("liquidity")), "log_open_interest": log(F.col("open_interest")),
        "related": count(F.col("related_market_count")), "evidence": count(F.col("evidence_count")), "has_related": (count(F.col("related_market_count")) > 0).cast("double"), "has_evidence": (count(F.col("evidence_count")) > 0).cast("double"),
    })


def forecast_metrics(rows: DataFrame, predictions: list[str], bins: int = 5) -> DataFrame:
    """Per prediction column: examples, Brier score, log loss, accuracy and calibration error against target (0/1).

    One pass: predictions become rows, bins are left-closed with bounds i / bins as sums of doubles give them, and the
    calibration error adds the bins' weighted gaps.
    """
    pairs = F.array(*(F.struct(F.lit(p).alias("name"), F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)).alias("q")) for p in predictions))
    x = rows.select("target", F.explode(pairs).alias("x")).select("target", "x.name", "x.q")
    size = 1.0 / bins
    bin_ = F.size(F.filter(F.array(*(F.lit(i * size) for i in range(1, bins))), lambda b: b <= F.col("q")))
    bounded = F.least(F.greatest(F.col("q"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -(F.col("target") * F.log(bounded) + (1 - F.col("target")) * F.log(1 - bounded))
    per = x.groupBy("name", bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("q") - F.col("target"), 2)).alias("b"), F.sum(loss).alias("l"), F.sum(((F.col("q") >= 0.5).cast("int") == F.col("target")).cast("int")).alias("h"), F.sum("target").alias("t"), F.sum("q").alias("q"))
    out = per.groupBy("name").agg(F.sum("n").alias("examples"), (F.sum("b") / F.sum("n")).alias("brier"), (F.sum("l") / F.sum("n")).alias("log_loss"), (F.sum("h") / F.sum("n")).alias("accuracy"), (F.sum(F.abs(F.col("t") - F.col("q"))) / F.sum("n")).alias("calibration_error"), (F.sum("t") / F.sum("n")).alias("positive_rate"))
    return out.withColumnRenamed("name", "prediction")


def calibration_table(rows: DataFrame, p: str = "p", bins: int = 5) -> DataFrame:
    """Observed rate, mean prediction and count per right-closed bin of width 1 / bins."""
    bin_ = F.greatest(F.ceil(F.col(p) * bins).cast("int") - 1, F.lit(0))
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("target").alias("observed"), F.avg(p).alias("predicted"))


def dataset_profile(df: DataFrame, event: str = "event_slug") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.countDistinct(event).alias("events"))


def quality_metrics(rows: DataFrame) -> DataFrame:
    """Mean target, approval rate, MAE and RMSE of predicted against target."""
    gap = F.col("predicted") - F.col("target")
    return rows.agg(F.count("*").alias("examples"), F.avg("target").alias("mean_target"), F.avg(F.col("approved").cast("double")).alias("approval_rate"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """statistic rows of count, mean, stddev, min, quartiles and max."""
    return df.select(*cols).summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")


# ---- models -------------------------------------------------------------------------------------------------------


def logistic(x: np.ndarray, y: np.ndarray, epochs: int = 400, rate: float = 0.2, decay: float = 0.001):
    """(weights, bias, means, scales) by full-batch steps on z-scores; None where y has one class."""
    if len(set(y.tolist())) < 2:
        return None
    means, scales = x.mean(axis=0), x.std(axis=0)
    scales[scales == 0] = 1.0
    z, w, prior = (x - means) / scales, np.zeros(x.shape[1]), y.mean()
    b = np.log(prior / (1 - prior))
    for _ in range(epochs):
        e = sigmoid(z @ w + b) - y
        w, b = w - rate * (z.T @ e / len(y) + decay * w), b - rate * e.mean()
    return w, b, means, scales


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expanding_folds(df: DataFrame, order: list[str], min_train: int = 8) -> DataFrame:
    """df with its position in order (1 ..), and fold: the position where it is evaluated, null for the first min_train rows.

    Rows are dealt out by ranges of the order and numbered within each; the numbers of rows of the ranges before, a row
    for each range, are added. Ties in order fall into one range and stand there in no set order.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    id_ = F.monotonically_increasing_id()  # the range in the upper 31 bits, the place in it in the lower 33
    rows = kept(parts.withColumn("_id", id_), "ordered").withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(before), "_part").withColumn("ord", (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_id", "_part", "_at", "_before")
    return out.withColumn("fold", F.when(F.col("ord") > min_train, F.col("ord")))


def fit_logistic(df: DataFrame, by: str, features: list[str] = FEATURES, epochs: int = 400, held: int = 500_000) -> DataFrame:
    """Per group: prior, weights, bias, means and scales of a logistic model of target; weights are null where a group has one class.

    Groups of at most `held` rows are fitted where they meet. The rows of larger ones stay where they are: each step adds up gradients
    over all of them (descend). There may be as many groups as a table of a row for each, which is counted, can hold.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y = part["target"].to_numpy(float)
        m = logistic(part[features].to_numpy(float), y, epochs)
        row = [part[by].iloc[0], float(np.clip(y.mean(), 1e-6, 1 - 1e-6))] + ([m[0], float(m[1]), m[2], m[3]] if m else [None, None, None, None])
        return pd.DataFrame([row], columns=[by, *MODEL_COLUMNS])

    ready(df.sparkSession)
    kind = df.schema[by].dataType.simpleString()
    large = [r[by] for r in df.groupBy(by).count().where(F.col("count") > held).select(by).collect()]  # at most rows / held of them
    small = df.where(~F.coalesce(F.col(by).isin(large), F.lit(False))) if large else df
    out = small.select(by, "target", *features).groupBy(by).applyInPandas(run, f"{by} {kind}, {MODEL}")
    return out.unionByName(descend(df.where(F.col(by).isin(large)), by, large, features, epochs)) if large else out


MODEL = "prior double, weights array<double>, bias double, means array<double>, scales array<double>"
MODEL_COLUMNS = [x.split()[0] for x in MODEL.split(", ")]


def descend(df: DataFrame, by: str, models: list, features: list[str] = FEATURES, epochs: int = 400, rate: float = 0.2, decay: float = 0.001, before: bool = False) -> DataFrame:
    """fit_logistic for some groups, or with before for models of all rows whose group comes before theirs, by as many jobs as there are steps.

    Rows are written once, as matrices of up to 10,000 rows of one group: a step hands out the models' weights, and each task returns the sums
    of its rows' gradients, ten numbers for each model; no row is copied into the models that it belongs to, and all of them take a matrix
    at once, by products of matrices. The rows are centred and scaled by the last model's means and scales, and each model's own are put
    into its weights. Models are few (a year or a month each).
    """
    spark, n = df.sparkSession, len(features)
    models, kind = sorted(models), df.schema[by].dataType.simpleString()
    rows = kept(df.select(by, F.col("target").cast("double").alias("target"), *(F.col(c).cast("double").alias(c) for c in features)).where(F.col(by).isNotNull()).sortWithinPartitions(by), "training")

    def mine(group) -> slice:
        """The models that rows of a group belong to: those after it, or its own."""
        return slice(bisect_right(models, group), len(models)) if before else slice(bisect_left(models, group), bisect_right(models, group))

    def summed(f, width: int) -> np.ndarray:
        """The sum over all rows of f(x, y, models), which gives width numbers for each of their models: models x width."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(models), width))
            for b in batches:
                for group, g in b.groupby(by):
                    total[mine(group)] += f(g[features].to_numpy(float), g["target"].to_numpy(float), mine(group))
            yield pd.DataFrame({"k": np.arange(len(models) * width), "v": total.ravel()})

        sums = rows.mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        return np.array([r.v for r in sorted(sums)] or np.zeros(len(models) * width)).reshape(len(models), width)

    first = summed(lambda x, y, ks: np.tile([len(y), y.sum(), *x.sum(0)], (len(models[ks]), 1)), n + 2)
    count = np.maximum(first[:, 0], 1)
    means = first[:, 2:] / count[:, None]
    spread = summed(lambda x, y, ks: np.array([((x - m) ** 2).sum(0) for m in means[ks]]).reshape(-1, n), n)
    scales = np.sqrt(spread / count[:, None])
    scales[scales <= 1e-12 * (1 + np.abs(means))] = 1.0
    share = first[:, 1] / count
    prior = np.clip(share, 1e-6, 1 - 1e-6)
    weights, bias = np.zeros((len(models), n)), np.log(prior / (1 - prior))
    middle, unit = (means[-1], scales[-1]) if models else (np.zeros(n), np.ones(n))
    off, wide = (means - middle) / unit, scales / unit

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(*mine(group).indices(len(models))[:2], np.column_stack([(g[features].to_numpy(float) - middle) / unit, g["target"].to_numpy(float)]).tobytes()) for group, g in b.groupby(by)]
            yield pd.DataFrame([x for x in found if x[0] < x[1]], columns=["lo", "hi", "rows"])

    packed = kept(rows.mapInPandas(pack, "lo int, hi int, rows binary"), "matrices", compression="none")
    for _ in range(epochs):
        total = np.zeros((len(models), n + 1))
        w, c = weights / wide, bias - (weights * off / wide).sum(1)

        def gradient(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, c: np.ndarray = c) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(c), n + 1))
            for b in batches:
                for lo, hi, data in zip(b.column("lo").to_pylist(), b.column("hi").to_pylist(), b.column("rows"), strict=True):
                    whole = np.frombuffer(data.as_buffer()).reshape(-1, n + 1)
                    for i in range(0, len(whole), 2000):
                        x, y = whole[i : i + 2000, :n], whole[i : i + 2000, n:]
                        e = sigmoid(x @ w[lo:hi].T + c[lo:hi]) - y
                        out[lo:hi, :n] += e.T @ x
                        out[lo:hi, n] += e.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        for r in packed.mapInArrow(gradient, "sums binary").collect():  # a row for each task, in the order of tasks
            total += np.frombuffer(r.sums).reshape(len(models), n + 1)
        g = total / count[:, None]
        slope = (g[:, :n] - off * g[:, n:]) / wide
        weights, bias = weights - rate * (slope + decay * weights), bias - rate * g[:, n]
    out = []
    for k, name in enumerate(models):
        fit = [weights[k].tolist(), float(bias[k]), means[k].tolist(), scales[k].tolist()] if 0 < share[k] < 1 else [None] * 4
        if first[k, 0]:
            out.append((name, float(prior[k]), *fit))
    return spark.createDataFrame(out, f"{by} {kind}, {MODEL}")


def predict_logistic(df: DataFrame, models: DataFrame, by: str, features: list[str] = FEATURES) -> DataFrame:
    """df with model_probability from its group's model."""
    x = df.join(models, by)
    z = F.zip_with(F.array(*features), F.zip_with("means", "scales", lambda m, s: F.struct(m.alias("m"), s.alias("s"))), lambda v, k: (v - k["m"]) / k["s"])
    dot = F.aggregate(F.zip_with(z, "weights", lambda a, w: a * w), F.col("bias"), lambda s, v: s + v)
    return x.withColumn("model_probability", F.when(F.col("weights").isNull(), F.col("prior")).otherwise(1 / (1 + F.exp(-F.least(F.greatest(dot, F.lit(-30.0)), F.lit(30.0)))))).drop("prior", "weights", "bias", "means", "scales")


def forecast_backtest(examples: DataFrame, min_train: int = 8, mode: str = "blocks", block: str = "block", sample: int | None = None, held: int = 500_000, epochs: int = 400) -> DataFrame:
    """examples evaluated by models fitted on what came before them.

    exact: a model for each evaluated row, of all rows before it; quadratic, for parity on small data. blocks: a model for
    each value of block (say a month), of the rows of earlier blocks: of up to `held` rows in one task for each, beyond by gradients summed
    over all rows (descend), which copies none; a logistic regression of pyspark.ml when asked for by mode ml. Rows before the first min_train are not evaluated.
    """
    if mode == "exact":
        rows = expanding_folds(examples, ["ts_us", "snapshot_id"], min_train)
        folds = rows.where("fold is not null").select(F.col("fold").alias("f"))
        train = rows.join(folds, F.col("ord") < F.col("f"))
        models = fit_logistic(train, "f")
        return predict_logistic(rows.where("fold is not null").withColumn("f", F.col("fold")), models, "f").drop("f")
    examples = kept(examples, "examples")  # counted, fitted and scored
    blocks = examples.groupBy(block).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    folds = blocks.select(F.col(block).alias("f"), before.alias("seen")).where(F.col("seen") >= min_train).select("f")
    if mode == "ml":
        return _ml_backtest(examples, folds, block)
    if examples.count() > held:
        ready(examples.sparkSession)
        models = descend(examples, block, [r.f for r in folds.collect()], epochs=epochs, before=True).withColumnRenamed(block, "f")  # a row for each block
    else:
        models = fit_logistic(examples.join(F.broadcast(folds), F.col(block) < F.col("f")), "f", epochs=epochs, held=held)
    return predict_logistic(examples.withColumn("f", F.col(block)), models, "f").drop("f")


def _ml_backtest(examples: DataFrame, folds: DataFrame, block: str) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = None
    for row in folds.orderBy("f").toLocalIterator():  # a fit for each block; its rows stay in Spark
        steps = [VectorAssembler(inputCols=FEATURES, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol="target", regParam=0.001, predictionCol="_y", probabilityCol="_p", rawPredictionCol="_w")]
        model = Pipeline(stages=steps).fit(examples.where(F.col(block) < row["f"]))
        part = model.transform(examples.where(F.col(block) == row["f"])).withColumn("model_probability", F.get(vector_to_array("_p"), F.lit(1))).select(*examples.columns, "model_probability")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else examples.limit(0).withColumn("model_probability", F.lit(0.0))


def score_with(df: DataFrame, predict, features: list[str], out: str = "model_score") -> DataFrame:
    """df with a trained model's scores: predict takes a pandas frame of features and returns a series; Arrow batches."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(predict(part))

    ready(df.sparkSession)
    return df.withColumn(out, run(F.struct(*features)))
