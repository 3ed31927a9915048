"""Exact attribution of scores to features: path-dependent Shapley values of tree ensembles.

A feature that is not known sends a row down both branches of a split, in the proportions of
the training rows. Every leaf is a small game of its own: of the distinct features on its path,
each lets the row through or not (known), or a share of it (unknown). The sums over subsets
are products of polynomials, so nothing is enumerated, and rows that pass the same features
share one calculation. Linear models have their weights times the distance from the mean.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.models.learners import FEATURES
from lodeworks.operators.columns import aligned
from lodeworks.session import fresh_path


#: Patterns of at most so many features are found by counting.
COUNTED_BITS = 12


class Leaf(NamedTuple):
    """What a leaf adds to a prediction, and for each feature on its path the values let
    through (above ``low``, up to ``high``) and the share of training rows let through."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def tree_leaves(model) -> tuple[list[Leaf], float]:
    """Leaves of a fitted tree ensemble and its mean prediction; sizes are the model's own."""
    spark = SparkSession.active()
    path = fresh_path(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else []
    if type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / model.getNumTrees] * model.getNumTrees
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    leaves, base = [], 0.0
    for tree, nodes in sorted(trees.items()):
        todo = [(nodes[0], {}, 1.0)]
        while todo:
            node, path, reach = todo.pop()
            if node["leftChild"] < 0:
                value = weights[tree] * node["prediction"]
                base += value * reach
                names = sorted(path)
                columns = [np.array([path[f][i] for f in names]) for i in range(3)]
                leaves.append(Leaf(value, np.array(names, np.int64), *columns))
                continue
            feature = node["split"]["featureIndex"]
            edge = node["split"]["leftCategoriesOrThreshold"][0]
            if node["split"]["numCategories"] != -1:
                raise ValueError("splits on categories are not attributed")
            low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
            total = node["impurityStats"][0]
            for child, ends in (("leftChild", (low, min(high, edge))), ("rightChild", (max(low, edge), high))):
                below = nodes[node[child]]
                part = below["impurityStats"][0] / total
                todo.append((below, {**path, feature: (*ends, share * part)}, reach * part))
    return leaves, base


def _grown(lines: np.ndarray, through: np.ndarray, share: float) -> np.ndarray:
    """Polynomials times (share + through t), one row a pattern."""
    out = np.zeros((lines.shape[0], lines.shape[1] + 1))
    out[:, :-1] = lines * share
    out[:, 1:] += lines * through[:, None]
    return out


def leaf_values(through: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf of value 1, per row of ``through`` (passes or not, 1 or 0)."""
    n, m = through.shape
    weights = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
    before, after = [np.ones((n, 1))], [np.ones((n, 1))]
    for i in range(m):
        before.append(_grown(before[-1], through[:, i], share[i]))
        after.append(_grown(after[-1], through[:, m - 1 - i], share[m - 1 - i]))
    out = np.empty((n, m))
    for j in range(m):
        one, two = before[j], after[m - 1 - j]
        spread = weights[np.add.outer(np.arange(one.shape[1]), np.arange(two.shape[1]))]
        out[:, j] = (through[:, j] - share[j]) * np.einsum("na,ab,nb->n", one, spread, two)
    return out


def attributed(rows: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Sum of the leaves' Shapley values, one row and column per row and feature of ``rows``."""
    columns = np.ascontiguousarray(rows.T)
    out = np.zeros_like(columns)
    for leaf in leaves:
        m = len(leaf.features)
        if not m:
            continue
        code = np.zeros(len(rows), np.int64)
        for j, f in enumerate(leaf.features.tolist()):
            code |= ((columns[f] > leaf.low[j]) & (columns[f] <= leaf.high[j])).astype(np.int64) << j
        if m <= COUNTED_BITS:  # counting finds the patterns without a sort
            seen = np.flatnonzero(np.bincount(code, minlength=1 << m))
            place = np.zeros(1 << m, np.int64)
            place[seen] = np.arange(len(seen))
            pattern = place[code]
        else:
            seen, pattern = np.unique(code, return_inverse=True)
        passes = (seen[:, None] >> np.arange(m)) & 1
        values = np.ascontiguousarray(leaf.value * leaf_values(passes.astype(float), leaf.share).T)
        for j, f in enumerate(leaf.features.tolist()):
            out[f] += values[j][pattern]
    return out.T


def attributions(ensemble, df: DataFrame, keep: list[str]) -> tuple[DataFrame, float]:
    """``keep`` and a column per feature, and the mean score that the columns add up from.

    A row's columns and the mean add up to the weighted sum of the base models, before any
    limiting to 0..1. Features that the preparation leaves out have 0.
    """
    selector = next((s for s in ensemble.preparation.stages if hasattr(s, "selectedFeatures")), None)
    if selector is None:
        raise ValueError("attributions refer to components here, not to features")
    chosen = [ensemble.features[i] for i in selector.selectedFeatures]
    leaves, linear, base = [], np.zeros(len(chosen)), float(ensemble.stacker.intercept)
    for name, weight in zip(ensemble.names, ensemble.stacker.coefficients, strict=True):
        model = ensemble.models[name].stages[-1]
        if hasattr(model, "coefficients"):
            # prepared features have mean 0 on the training rows
            linear += weight * model.coefficients.toArray()
            base += float(weight) * model.intercept
        elif hasattr(model, "featureImportances"):
            own, mean = tree_leaves(model)
            leaves += [x._replace(value=x.value * float(weight)) for x in own]
            base += float(weight) * mean
        else:
            raise ValueError(f"{name} has no attribution by feature")
    prepared = ensemble.preparation.transform(aligned(df, ensemble.features, keep))
    shared = df.sparkSession.sparkContext.broadcast((leaves, linear))

    def work(batches):
        own, weights = shared.value
        for batch in batches:
            flat = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False)
            rows = flat.reshape(batch.num_rows, len(chosen)).astype(float)
            total = attributed(rows, own) + rows * weights
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], *(pa.array(total[:, j]) for j in range(len(chosen)))],
                names=[*keep, *chosen])

    inputs = prepared.select(*[F.col(f"`{c}`") for c in keep], vector_to_array(FEATURES).alias("_x"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields[:-1]]
                      + [f"`{c}` double" for c in chosen])
    found = inputs.mapInArrow(work, kinds)
    return found.select(*[F.col(f"`{c}`") for c in keep], *[
        F.col(f"`{c}`") if c in chosen else F.lit(0.0).alias(c) for c in ensemble.features]), base


def attribution_impact(ensemble, df: DataFrame, key: str = "hole_id", top: int = 5) -> DataFrame:
    """Features of greatest mean absolute attribution: feature, impact."""
    found, _ = attributions(ensemble, df, [key])
    means = found.agg(*[F.avg(F.abs(F.col(f"`{c}`"))).alias(c) for c in ensemble.features])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("impact")) for c in ensemble.features])
    return means.select(F.inline(pairs)).orderBy(F.col("impact").desc(), "feature").limit(top)
