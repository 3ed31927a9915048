"""Shapley values against their definition, by enumeration of all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from lodeworks.models import attribution, ensemble, folds, learners
from lodeworks.session import fresh_path


def frame(spark, n=150, m=6):
    rng = np.random.default_rng(21)
    x = np.round(rng.random((n, m)), 2)
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0.5, x[:, 3], 0) + 0.1 * rng.random(n)
    return x, spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])


def expectation(nodes, weights, x, known):
    """Mean prediction when only the features in ``known`` are given."""
    def below(tree, i):
        node = nodes[tree][i]
        if node["leftChild"] < 0:
            return node["prediction"]
        left, right = node["leftChild"], node["rightChild"]
        f = node["split"]["featureIndex"]
        if f in known:
            return below(tree, left if x[f] <= node["split"]["leftCategoriesOrThreshold"][0] else right)
        a, b = (nodes[tree][c]["impurityStats"][0] for c in (left, right))
        return (a * below(tree, left) + b * below(tree, right)) / (a + b)

    return sum(w * below(t, 0) for t, w in enumerate(weights))


@pytest.mark.parametrize("make", [
    lambda: RandomForestRegressor(numTrees=4, maxDepth=5, seed=3),
    lambda: GBTRegressor(maxIter=4, maxDepth=4, seed=3),
])
def test_values_equal_enumeration_and_add_up(spark, make):
    x, df = frame(spark)
    model = make().fit(df)
    leaves, base = attribution.tree_leaves(model)
    path = fresh_path(spark, "trees")
    model.write().save(path)
    nodes = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    weights = list(model.treeWeights) if isinstance(make(), GBTRegressor) else [0.25] * 4
    rows = x[:12]
    got = attribution.attributed(rows, leaves)
    m = x.shape[1]
    for row, values in zip(rows, got):
        game = {s: expectation(nodes, weights, row, set(s))
                for k in range(m + 1) for s in itertools.combinations(range(m), k)}
        assert base == pytest.approx(game[()])
        for j in range(m):
            want = sum(
                math.factorial(len(s)) * math.factorial(m - 1 - len(s)) / math.factorial(m)
                * (game[tuple(sorted((*s, j)))] - game[s]) for s in game if j not in s)
            assert values[j] == pytest.approx(want, abs=1e-12)
        assert base + values.sum() == pytest.approx(model.predict(Vectors.dense(row)))


def test_attributions_of_an_ensemble_add_up_to_its_score(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{i}", float(a), float(b), float(c), float(0.2 + 0.5 * a * b)) for i, (a, b, c) in enumerate(rng.random((80, 3)))]
    rows[3] = ("h3", None, 0.5, float("nan"), 0.3)
    df = spark.createDataFrame(rows, "hole_id string, a double, b double, `c d` double, y double").withColumn(
        "fold", folds.hashed_fold(F.col("hole_id"), 3))
    models = {"gb": learners.Boosted(5, 3), "rf": learners.Forest(5, 4), "sgd": learners.RobustLinear(iterations=20)}
    names = ["a", "b", "c d"]
    fitted, _ = ensemble.train_ensemble(df, names, "y", models)
    found, base = attribution.attributions(fitted, df, ["hole_id"])
    assert found.columns == ["hole_id", *names]
    raw = ensemble._predict(fitted.preparation, fitted.models, df, ["hole_id"])
    total = {r["hole_id"]: float(fitted.stacker.intercept) + sum(
        float(w) * r[n] for w, n in zip(fitted.stacker.coefficients, fitted.names)) for r in raw.collect()}
    for r in found.collect():
        assert base + sum(r[n] for n in names) == pytest.approx(total[r["hole_id"]], abs=1e-9)
    impact = attribution.attribution_impact(fitted, df, top=2).collect()
    assert len(impact) == 2 and impact[0]["impact"] >= impact[1]["impact"] > 0
    assert attribution.attributions(fitted, df.limit(0), ["hole_id"])[0].count() == 0


def test_patterns_found_by_counting_or_sorting_are_the_same(spark, monkeypatch):
    x, df = frame(spark)
    leaves, _ = attribution.tree_leaves(RandomForestRegressor(numTrees=3, maxDepth=5, seed=3).fit(df))
    counted = attribution.attributed(x, leaves)
    monkeypatch.setattr(attribution, "COUNTED_BITS", 0)
    np.testing.assert_array_equal(attribution.attributed(x, leaves), counted)
    assert attribution.attributed(x[:0], leaves).shape == (0, x.shape[1])
