"""The robust linear learner against its optimality conditions, and sums in a tree."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors

from lodeworks.models import huber, learners
from lodeworks.operators import sums


def data(spark, n=400, parts=3):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(n, 6))
    x[:, 5] = 0.0  # a column without any spread
    y = x @ [0.6, -0.3, 0.0, 0.02, 0.0, 0.0] + 0.4 + 0.05 * rng.normal(size=n)
    y[::15] += 5.0  # outliers
    rows = [(Vectors.dense(a), float(b)) for a, b in zip(x, y)]
    rows.append((Vectors.dense(x[0]), None))
    return x, y, spark.createDataFrame(rows, ["features", "y"]).repartition(parts)


@pytest.mark.parametrize("penalty,share", [(0.01, 0.15), (0.05, 1.0), (0.02, 0.0), (10.0, 0.5)])
def test_optimality_conditions_hold(spark, penalty, share):
    x, y, df = data(spark)
    weights, intercept, off = huber.huber_elastic_net(df, "features", "y", penalty, share)
    assert off <= 1e-6
    rest = y - x @ weights - intercept
    slope = np.clip(rest, -huber.EPSILON, huber.EPSILON)
    pull = x.T @ slope / len(y) - penalty * (1 - share) * weights
    lasso = penalty * share
    assert abs(slope.mean()) <= 1e-6
    assert np.all(np.where(weights != 0, np.abs(pull - lasso * np.sign(weights)) <= 1e-6, np.abs(pull) <= lasso + 1e-6))
    assert weights[5] == 0 and (penalty < 1 or np.all(weights == 0) or share == 0)

    def loss(w, b):
        r = np.abs(y - x @ w - b)
        one = np.where(r <= huber.EPSILON, r * r / 2, huber.EPSILON * r - huber.EPSILON ** 2 / 2)
        return one.mean() + penalty * ((1 - share) * w @ w / 2 + share * np.abs(w).sum())

    rng = np.random.default_rng(1)
    best = loss(weights, intercept)
    for scale in (1e-3, 1e-1):
        assert all(loss(weights + scale * rng.normal(size=6), intercept + scale * rng.normal()) >= best for _ in range(50))


def test_the_fit_is_a_stored_model(spark, tmp_path):
    x, _, df = data(spark)
    train = df.dropna()
    fitted = learners.fitted_learner(train, "sgd", learners.RobustLinear(), "y", [])
    fitted.save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert [r["raw_sgd"] for r in fitted.transform(train).collect()] == [r["raw_sgd"] for r in again.transform(train).collect()]
    w, b, _ = huber.huber_elastic_net(train, "features", "y", 0.01)
    assert again.stages[-1].predict(Vectors.dense(x[3])) == pytest.approx(float(x[3] @ w + b))
    assert huber.huber_elastic_net(train.limit(0), "features", "y", 0.01)[1:] == (0.0, 0.0)


def test_sums_in_a_tree(spark):
    df = spark.range(0, 500, 1, 70).repartition(70)
    parts = sums.partitions(df)

    def of(batches):
        values = np.concatenate([np.zeros(0), *(b.column(0).to_numpy() for b in batches)])
        return np.array([values.sum(), len(values)]) if len(values) else None

    assert sums.vector_sum(df, parts, of).tolist() == [sum(range(500)), 500]
    assert sums.vector_sum(df.limit(0), 1, of) is None and sums.partitions(df.limit(0)) == 0
    assert isinstance(sums._row(1, np.ones(2)), pa.RecordBatch)
