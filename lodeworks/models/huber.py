"""Linear regression with Huber loss and an elastic net.

Huber loss lies below a weighted square that touches it at the present residuals, so each pass
over the rows sums one weighted Gram matrix, and coordinate descent solves the elastic net of
that square on the driver, where only (features + 1)^2 numbers arrive. Every step lowers the
loss; passes end when the optimality conditions of the Huber loss itself hold.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.sums import partitions, vector_sum

# Residual from which the loss is linear, share of the L1 penalty.
EPSILON, L1_SHARE = 0.1, 0.15
TOLERANCE = 1e-7
MOST_PASSES = 200


def _sums(params: np.ndarray, epsilon: float):
    """Weighted Gram matrix, weighted and clipped moments and count of a partition's rows."""
    def of(batches):
        size = len(params)
        gram, moment, slope, n = np.zeros((size, size)), np.zeros(size), np.zeros(size), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size - 1)
            x = np.column_stack([x, np.ones(len(x))])
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            rest = y - x @ params
            weight = epsilon / np.maximum(np.abs(rest), epsilon)
            gram += (x * weight[:, None]).T @ x
            moment += x.T @ (weight * y)
            slope += x.T @ (weight * rest)
            n += len(y)
        return np.concatenate([gram.ravel(), moment, slope, [n]]) if n else None

    return of


def descended(
    gram: np.ndarray, moment: np.ndarray, params: np.ndarray, ridge: float, lasso: float, sweeps: int = 20_000,
) -> np.ndarray:
    """Minimum of p G p / 2 - m p + ridge |w|^2 / 2 + lasso |w|_1; the last entry is free."""
    params = params.copy()
    last = len(params) - 1
    for _ in range(sweeps):
        moved = 0.0
        for j in range(last + 1):
            pull = moment[j] - gram[j] @ params + gram[j, j] * params[j]
            if j < last:
                new = np.sign(pull) * max(abs(pull) - lasso, 0.0) / (gram[j, j] + ridge) if gram[j, j] + ridge else 0.0
            else:
                new = pull / gram[j, j]
            moved = max(moved, abs(new - params[j]))
            params[j] = new
        if moved <= 1e-13 * (1 + np.abs(params).max()):
            break
    return params


def violation(slope: np.ndarray, params: np.ndarray, ridge: float, lasso: float) -> float:
    """How far the optimality conditions are from holding, given the mean clipped moments."""
    w, pull = params[:-1], slope[:-1] - ridge * params[:-1]
    off = np.where(w != 0, np.abs(pull - lasso * np.sign(w)), np.maximum(np.abs(pull) - lasso, 0))
    return float(max(np.abs(slope[-1]), off.max(initial=0.0)))


def huber_elastic_net(
    df: DataFrame, features: str, label: str, penalty: float, l1_share: float = L1_SHARE,
    epsilon: float = EPSILON, passes: int = MOST_PASSES, tolerance: float = TOLERANCE,
) -> tuple[np.ndarray, float, float]:
    """Weights, intercept and the remaining violation of the optimality conditions.

    Minimises mean huber(y - x w - b) + penalty ((1 - l1_share) |w|^2 / 2 + l1_share |w|_1).
    ``features`` is a vector column. Rows without a label or features are left out; without
    any row all is 0. ``df`` is read once a pass, so stage or persist what is dear.
    """
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).filter(
        "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    first = rows.first()
    if first is None:
        return np.zeros(0), 0.0, 0.0
    params, parts = np.zeros(len(first["x"]) + 1), partitions(rows)
    ridge, lasso = penalty * (1 - l1_share), penalty * l1_share
    size, off = len(params), np.inf
    for _ in range(passes):
        flat = vector_sum(rows, parts, _sums(params, epsilon))
        flat = flat[:-1] / flat[-1]
        off = violation(flat[-size:], params, ridge, lasso)
        if off <= tolerance:
            break
        params = descended(flat[:size * size].reshape(size, size), flat[size * size:-size], params, ridge, lasso)
    return params[:-1], float(params[-1]), off


def as_model(df: DataFrame, weights: np.ndarray, intercept: float, features: str, prediction: str) -> LinearRegressionModel:
    """The fit as an MLlib model, so that it is stored and applied like any other."""
    context = df.sparkSession.sparkContext
    make = context._jvm.org.apache.spark.ml.regression.LinearRegressionModel
    model = LinearRegressionModel(make("huber_net", _py2java(context, DenseVector(weights)), intercept))
    return model.setFeaturesCol(features).setPredictionCol(prediction)
