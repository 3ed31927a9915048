"""Stacked ensemble: out-of-fold predictions, ridge stacker, scoring."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions.numeric import clip, score_100
from lodeworks.models.learners import FEATURES, fitted_learner, selected_preparation, training_quartiles
from lodeworks.operators.columns import aligned
from lodeworks.operators.exact import quantile
from lodeworks.operators.metrics import model_agreement, regression_metrics, roc_auc
from lodeworks.session import stage_table

# Quality gate and stacker penalty.
WORST_R2 = -5.0
STACK_PENALTY = 1.0
HIGH_GRADE_SHARE = 0.70
# Rows below which another task costs more than it saves.
ROWS_PER_TASK = 50_000


@dataclass
class Ensemble:
    """Fitted base models, their preparation and the stacker."""

    features: list[str]
    preparation: PipelineModel
    models: dict[str, PipelineModel]
    stacker: LinearRegressionModel
    metrics: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return sorted(self.models)


def ridge(df: DataFrame, predictions: list[str], label: str, penalty: float = STACK_PENALTY):
    """Ridge regression with an unpenalised intercept and the given alpha.

    MLlib averages the loss and scales the label, so alpha is divided by the
    row count and multiplied by the label's spread.
    """
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s")).first()
    strength = penalty * (stats["s"] or 1.0) / max(stats["n"], 1)
    vectors = VectorAssembler(inputCols=predictions, outputCol="stack").transform(df)
    return LinearRegression(
        featuresCol="stack", labelCol=label, predictionCol="stacked", solver="normal",
        standardization=False, elasticNetParam=0.0, regParam=strength,
    ).fit(vectors)


def stack(model: LinearRegressionModel, df: DataFrame, predictions: list[str]) -> DataFrame:
    """Add the clipped stacker output as ``stacked``."""
    weights = zip(model.coefficients, predictions)
    total = F.lit(float(model.intercept))
    for weight, name in weights:
        total = total + F.lit(float(weight)) * F.col(name)
    return df.withColumn("stacked", clip(total, 0.0, 1.0))


def _predict(preparation, models: dict, df: DataFrame, keep: list[str]) -> DataFrame:
    """Base predictions as columns, all models in one narrow pass."""
    out = preparation.transform(df)
    for name in sorted(models):
        out = models[name].transform(out)
    return out.select(*keep, *[F.col(f"raw_{n}").alias(n) for n in sorted(models)])


def _side_by_side(spark: SparkSession, tasks: list[Callable], parallel: int | None = None) -> list:
    """What the tasks return; up to ``parallel`` of them (all, if not given) run at a time."""
    # Each task gets its own copy of the job properties.
    held = [inheritable_thread_target(spark)(task) for task in tasks]
    with ThreadPool(max(1, min(parallel or len(held), len(held)))) as pool:
        return pool.map(lambda task: task(), held, chunksize=1)


def _fit_all(train: DataFrame, features, label, learners, prepare: Callable, quartiles: dict):
    rows = train.count()
    preparation = prepare(train, features, label, rows, quartiles)
    # The boosted learner reads its input once per round, so it is kept, in no
    # more tasks than its rows are worth.
    tasks = max(1, math.ceil(rows / ROWS_PER_TASK))
    prepared = preparation.transform(train)
    # Learners read these only; the columns they come from would take most of the memory.
    used = [label, FEATURES, *[c for c in prepared.columns if c.startswith("sc_")]]
    prepared = prepared.select(*[F.col(f"`{c}`") for c in used]).coalesce(tasks).persist()
    try:
        names = sorted(learners)
        models = dict(zip(names, _side_by_side(train.sparkSession, [
            partial(fitted_learner, prepared, name, learners[name], label, features) for name in names])))
    finally:
        prepared.unpersist()
    return preparation, models


def out_of_fold(
    df: DataFrame, features: list[str], label: str, learners: dict, key: str = "hole_id",
    fold: str = "fold", prepare: Callable = selected_preparation, parallel: int = 5,
    quartiles: dict | None = None,
) -> DataFrame:
    """Each row predicted by models that never saw its fold.

    Medians, selection and scaling are fit on the training folds only; the order statistics of
    all training sets (``quartiles``) come from one search over ``df``, which should be staged.
    Folds are fitted ``parallel`` at a time.
    """
    if quartiles is None:
        quartiles = training_quartiles(df, features, fold)
    folds = sorted(k for k in quartiles if k is not None)
    keep = [key, label, fold]

    def one(number):
        train = df.filter(F.col(fold) != number)
        preparation, models = _fit_all(train, features, label, learners, prepare, quartiles[number])
        return _predict(preparation, models, df.filter(F.col(fold) == number), keep)

    parts = _side_by_side(df.sparkSession, [partial(one, n) for n in folds], parallel)
    return stage_table(reduce(DataFrame.unionByName, parts), "out-of-fold")


def qualified(scores: dict[str, float]) -> list[str]:
    """Models above the quality gate, or the best one when none passes."""
    good = sorted(n for n, r2 in scores.items() if r2 > WORST_R2)
    return good or [max(scores, key=scores.get)]


def stacked_out_of_fold(oof: DataFrame, names: list[str], label: str, fold: str) -> DataFrame:
    """Stacker predictions, again by models that never saw the fold."""
    folds = sorted(r[fold] for r in oof.select(fold).distinct().collect())
    parts = [
        stack(ridge(oof.filter(F.col(fold) != n), names, label),
              oof.filter(F.col(fold) == n), names)
        for n in folds
    ]
    return reduce(DataFrame.unionByName, parts)


def evaluate(stacked: DataFrame, names: list[str], label: str) -> dict:
    """R2, RMSE, AUC at the high-grade threshold and mean confidence."""
    errors = {r["model"]: r for r in regression_metrics(
        stacked, label, [*names, "stacked"]).collect()}
    high = F.col(label) >= F.lit(quantile(stacked, label, HIGH_GRADE_SHARE))
    auc = roc_auc(stacked, high, "stacked").first()["roc_auc"]
    confidence = (
        model_agreement(stacked, names).agg(F.avg("confidence")).first()[0]
        if len(names) > 1 else 1.0
    )
    return {
        "cv_r2": errors["stacked"]["r2"], "rmse": errors["stacked"]["rmse"],
        "roc_auc": auc or 0.0, "confidence": confidence,
        "model_scores": {n: errors[n]["r2"] for n in names},
    }


def train_ensemble(
    df: DataFrame, features: list[str], label: str, learners: dict, key: str = "hole_id",
    fold: str = "fold", prepare: Callable = selected_preparation,
) -> tuple[Ensemble, DataFrame]:
    """Fit the ensemble; returns it with the staged out-of-fold table.

    The models of all rows are fitted beside those of the folds: much of a fit is waiting for
    one short job after another. Those that don't pass the quality gate are left out.
    """
    quartiles = training_quartiles(df, features, fold)
    oof, (preparation, models) = _side_by_side(df.sparkSession, [
        partial(out_of_fold, df, features, label, learners, key, fold, prepare, quartiles=quartiles),
        partial(_fit_all, df, features, label, learners, prepare, quartiles[None])])
    scores = {
        r["model"]: r["r2"] if r["r2"] is not None else float("-inf")
        for r in regression_metrics(oof, label, sorted(learners)).collect()
    }
    names = qualified(scores)
    stacked = stage_table(stacked_out_of_fold(oof, names, label, fold), "stacked")
    models = {n: models[n] for n in names}
    stacker = ridge(oof, names, label)
    metrics = evaluate(stacked, names, label)
    metrics["model_scores"] = scores
    metrics["weights"] = dict(zip(names, [float(w) for w in stacker.coefficients]))
    return Ensemble(features, preparation, models, stacker, metrics), stacked


def score(ensemble: Ensemble, df: DataFrame, keep: list[str]) -> DataFrame:
    """Prospectivity and 0-100 score of every row; missing features count as 0."""
    inputs = aligned(df, ensemble.features, keep)
    base = _predict(ensemble.preparation, ensemble.models, inputs, keep)
    limited = base.withColumns({n: clip(F.col(n), 0.0, 1.0) for n in ensemble.names})
    return (
        stack(ensemble.stacker, limited, ensemble.names)
        .withColumnRenamed("stacked", "prospectivity")
        .withColumn("score_100", score_100(F.col("prospectivity")))
    )


def importances(ensemble: Ensemble, top: int = 15) -> DataFrame:
    """Summed tree importances per feature, largest first."""
    selector = next(
        (s for s in ensemble.preparation.stages if hasattr(s, "selectedFeatures")), None)
    if selector is None:
        raise ValueError("importances refer to components here, not to features")
    chosen = [ensemble.features[i] for i in selector.selectedFeatures]
    rows = []
    for name in ensemble.names:
        model = ensemble.models[name].stages[-1]
        if hasattr(model, "featureImportances"):
            values = model.featureImportances.toArray()
            rows += [(name, f, float(v)) for f, v in zip(chosen, values)]
    spark = SparkSession.active()
    table = spark.createDataFrame(rows, "model string, feature string, importance double")
    return (
        table.groupBy("feature").agg(F.sum("importance").alias("importance"))
        .orderBy(F.col("importance").desc(), "feature").limit(top)
    )


def permutation_impact(
    ensemble: Ensemble, df: DataFrame, label: str, features: list[str], key: str = "hole_id"
) -> DataFrame:
    """Mean absolute change of the score when one feature is shuffled over rows.

    An approximation of attribution for tree models. Values are exchanged by
    position along two digests of the key. One join deals out all features, and one
    scoring pass takes a variant of each row per feature, so the plan does not
    grow with the features. Rows without a key are not counted; rows that share a key are
    compared with each other.
    """
    spark = df.sparkSession
    base = score(ensemble, df, [key]).filter(F.col(key).isNotNull())
    before = base.groupBy(key).agg(F.collect_list("prospectivity").alias("_before"))
    dealt = _exchanged(df, features, key)
    # sizes of files say little about rows here, so neither side is broadcast
    rows = stage_table(dealt.join(stage_table(before, "base-scores").hint("merge"), key), "dealt")
    own = [c for c in ensemble.features if c in df.columns]
    place = {c: i for i, c in enumerate(features)}

    def variant(n: int, feature: str) -> Column:
        return F.struct(F.lit(n).alias("_n"), *[
            F.col(f"_dealt.d{place[c]}" if c == feature else f"`{c}`").cast("double").alias(c) for c in own])

    variants = rows.select("_before", F.explode(F.array(*[
        variant(n, c) for n, c in enumerate(features)])).alias("_v")).select("_before", "_v.*")
    after = score(ensemble, variants, ["_n", "_before"]).select(
        "_n", "prospectivity", F.explode("_before").alias("_was"))
    found = after.groupBy("_n").agg(F.avg(F.abs(F.col("prospectivity") - F.col("_was"))).alias("impact"))
    names = spark.createDataFrame(list(enumerate(features)), "_n int, feature string")
    return names.join(found, "_n", "left").select("feature", "impact").orderBy(F.col("impact").desc(), "feature")


def _exchanged(df: DataFrame, features: list[str], key: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """``df`` with the features of another row as ``_dealt`` (fields d0, d1 ...).

    Rows are dealt inside hashed buckets, so no ordering spans the table.
    """
    buckets = max(1, math.ceil(df.count() / rows_per_bucket))
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))

    def seated(rows, salt):
        order = W.partitionBy("_bucket").orderBy(F.xxhash64(F.col(key), F.lit(salt)), key)
        return rows.withColumn("_bucket", bucket).withColumn("_seat", F.row_number().over(order))

    gifts = F.struct(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(features)])
    donors = seated(df.select(key, gifts.alias("_dealt")), "from").select("_bucket", "_seat", "_dealt")
    return seated(df, "to").join(donors.hint("merge"), ["_bucket", "_seat"]).drop("_bucket", "_seat")
