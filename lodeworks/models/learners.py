"""Preprocessing stages and base learners as MLlib pipelines."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    PCA, SQLTransformer, StandardScaler, UnivariateFeatureSelector, VectorAssembler,
)
from pyspark.ml.regression import (
    GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.models.huber import as_model, huber_elastic_net
from lodeworks.operators.columns import medians, robust_ranges, robust_statistics
from lodeworks.operators.exact import held_out_quantiles

SEED = 42
FEATURES = "features"


@dataclass(frozen=True)
class Forest:
    """Random forest; depth 30 is the deepest MLlib grows."""

    trees: int = 200
    depth: int = 30
    leaf: int = 2
    subset: str = "all"
    sample: float = 1.0

    def regressor(self):
        return RandomForestRegressor(
            numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=self.leaf,
            featureSubsetStrategy=self.subset, subsamplingRate=self.sample, seed=SEED,
            maxMemoryInMB=1024,
        )


@dataclass(frozen=True)
class Boosted:
    """Gradient-boosted trees."""

    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    sample: float = 0.8

    def regressor(self):
        return GBTRegressor(
            maxIter=self.rounds, maxDepth=self.depth, stepSize=self.rate,
            subsamplingRate=self.sample, seed=SEED,
        )


@dataclass(frozen=True)
class RobustLinear:
    """Huber loss with an elastic net."""

    penalty: float = 0.01
    iterations: int = 200

    def fit(self, prepared: DataFrame, label: str, prediction: str):
        weights, intercept, _ = huber_elastic_net(
            prepared, FEATURES, label, self.penalty, passes=self.iterations)
        return as_model(prepared, weights, intercept, FEATURES, prediction)


@dataclass(frozen=True)
class RandomFourier:
    """RBF kernel regression through random Fourier features and a Huber fit."""

    components: int = 200
    penalty: float = 0.001

    def regressor(self):
        return LinearRegression(
            loss="huber", regParam=self.penalty, elasticNetParam=0.0, maxIter=200
        )


# The two learner sets, grouped validation and grid scoring.
HOLE_LEARNERS = {"gb": Boosted(), "rf": Forest(), "sgd": RobustLinear()}
GRID_LEARNERS = {
    "rf": Forest(trees=500, depth=10, leaf=3, subset="sqrt", sample=0.8),
    "svm": RandomFourier(),
    "xgb": Boosted(rounds=300, depth=5),
}
MAX_COMPONENTS = 15


def _quoted(name: str) -> str:
    return f"`{name}`"


def _imputer(values: dict[str, float], features: list[str]) -> SQLTransformer:
    """Missing and non-finite inputs become the training median."""
    columns = ", ".join(
        f"coalesce(nullif(nanvl(CAST({_quoted(c)} AS DOUBLE), DOUBLE('Infinity')),"
        f" DOUBLE('Infinity')), {values[c]!r}D) AS {_quoted('in_' + c)}"
        for c in features
    )
    return SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")


def training_quartiles(df: DataFrame, features: list[str], fold: str) -> dict:
    """Quartiles of each feature over all rows, and over those outside each fold."""
    return held_out_quantiles(df, features, [0.25, 0.5, 0.75], fold)


def _middles(quartiles: dict[str, list]) -> dict[str, float]:
    return {c: q[1] if q[1] is not None else 0.0 for c, q in quartiles.items()}


def selected_preparation(
    train: DataFrame, features: list[str], label: str, rows: int, quartiles: dict | None = None,
) -> PipelineModel:
    """Median imputation, univariate selection and standardisation, fit on ``train``.

    ``quartiles`` are those of ``train`` where they are known already.
    """
    middles = medians(train, features) if quartiles is None else _middles(quartiles)
    top = min(len(features), max(10, rows // 2))
    selector = UnivariateFeatureSelector(
        featuresCol="raw_vector", labelCol=label, outputCol="chosen_vector",
        selectionMode="numTopFeatures",
    ).setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(top)
    return Pipeline(stages=[
        _imputer(middles, features),
        VectorAssembler(inputCols=["in_" + c for c in features], outputCol="raw_vector"),
        selector,
        StandardScaler(
            inputCol="chosen_vector", outputCol=FEATURES, withMean=True, withStd=True),
    ]).fit(train)


def component_preparation(
    train: DataFrame, features: list[str], label: str, rows: int, quartiles: dict | None = None,
) -> PipelineModel:
    """Median imputation, exact robust scaling and centred principal components."""
    stats = robust_statistics(train, features) if quartiles is None else robust_ranges(quartiles)
    middles = {c: mid for c, (mid, _) in stats.items()}
    scaled = ", ".join(
        f"({_quoted('in_' + c)} - {mid!r}D) / {width!r}D AS {_quoted('sc_' + c)}"
        for c, (mid, width) in stats.items()
    )
    k = max(1, min(MAX_COMPONENTS, len(features), rows - 2))
    return Pipeline(stages=[
        _imputer(middles, features),
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=["sc_" + c for c in features], outputCol="raw_vector"),
        StandardScaler(
            inputCol="raw_vector", outputCol="chosen_vector", withMean=True, withStd=False),
        PCA(k=k, inputCol="chosen_vector", outputCol=FEATURES),
    ]).fit(train)


def _fourier_stages(prepared: DataFrame, features: list[str], components: int) -> list:
    """cos(w x + b) features with fixed random w and b, as persistable SQL stages.

    Runs on the robust-scaled columns; the bandwidth is the usual
    1 / (features * variance of all scaled entries).
    """
    scaled = [F.col(f"`sc_{c}`") for c in features]
    squares = prepared.agg(
        *[F.avg(c * c).alias(f"s{i}") for i, c in enumerate(scaled)],
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(scaled)],
    ).first()
    width = len(features)
    mean = sum(squares[f"m{i}"] for i in range(width)) / width
    variance = sum(squares[f"s{i}"] for i in range(width)) / width - mean * mean
    spread = (2.0 / (width * (variance or 1.0))) ** 0.5
    draw = random.Random(SEED)
    rows = [[draw.gauss(0.0, spread) for _ in features] for _ in range(components)]
    shifts = [draw.uniform(0.0, 2 * math.pi) for _ in range(components)]
    root = (2.0 / components) ** 0.5

    def turn(row: list[float], shift: float) -> str:
        dot = " + ".join(f"{w!r}D * {_quoted('sc_' + c)}" for w, c in zip(row, features, strict=True))
        return f"0D + {dot} + {shift!r}D"

    # Terms are written out, as nested functions over arrays take twice as long. Without any such
    # function all terms would be one method, too long for the JVM to compile, and no faster.
    turns = ", ".join(turn(row, shift) for row, shift in zip(rows, shifts, strict=True))
    named = ", ".join(f"_waves[{j}] AS wave_{j}" for j in range(components))
    return [
        SQLTransformer(statement=f"SELECT *, transform(array({turns}), x -> {root!r}D * cos(x)) AS _waves FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, {named} FROM __THIS__"),
        VectorAssembler(
            inputCols=[f"wave_{j}" for j in range(components)], outputCol="fourier"),
    ]


def fitted_learner(
    prepared: DataFrame, name: str, learner, label: str, features: list[str]
) -> PipelineModel:
    """One base learner on prepared features; its prediction column is ``raw_<name>``."""
    if isinstance(learner, RobustLinear):
        return PipelineModel([learner.fit(prepared, label, f"raw_{name}")])
    regressor = learner.regressor().setLabelCol(label).setPredictionCol(f"raw_{name}")
    if not isinstance(learner, RandomFourier):
        return Pipeline(stages=[regressor.setFeaturesCol(FEATURES)]).fit(prepared)
    waves = ", ".join(["_waves", "fourier", *[f"wave_{j}" for j in range(learner.components)]])
    return Pipeline(stages=[
        *_fourier_stages(prepared, features, learner.components),
        regressor.setFeaturesCol("fourier"),
        # Working columns go before another learner runs on the same rows.
        SQLTransformer(statement=f"SELECT * EXCEPT ({waves}) FROM __THIS__"),
    ]).fit(prepared)
