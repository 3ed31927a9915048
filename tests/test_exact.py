"""Quantiles, running totals and ranking metrics against numpy, beyond one buffer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import exact
from lodeworks.operators.exact import exact_quantiles, running_totals
from lodeworks.operators.metrics import average_precision, roc_auc, score_curve


@pytest.mark.parametrize("hot", [False, True])
def test_bracketed_quantiles_equal_numpy(spark, hot):
    rng = np.random.default_rng(7)
    a = np.exp(rng.normal(size=6000) * 3)
    if hot:
        a[:2500] = 1.0  # one value holds much of the column
    b = rng.normal(size=6000)
    rows = [(float(x), None if i % 11 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.7, 0.95, 1.0]
    found = exact_quantiles(df, ["a", "b"], shares, buffer_values=600)
    kept = [y for _, y in rows if y is not None]
    np.testing.assert_allclose(found["a"], np.quantile(a, shares), rtol=1e-12)
    np.testing.assert_allclose(found["b"], np.quantile(kept, shares), rtol=1e-9)
    small = exact_quantiles(df, ["a", "b"], shares)
    np.testing.assert_allclose(small["a"], found["a"], rtol=1e-12)


def test_empty_column_has_no_quantile(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [1.5], "b": [None]}
    many = spark.range(900).select(F.col("id").cast("double").alias("a"),
                                   F.lit(None).cast("double").alias("b"))
    assert exact_quantiles(many, ["a", "b"], [0.5], buffer_values=200) == {
        "a": [449.5], "b": [None]}


def test_nan_is_skipped_at_any_size(spark):
    value = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("id") * 1.0)
    df = spark.range(900).select(value.alias("a"))
    expected = np.quantile([i for i in range(900) if i % 3], [0.5, 0.9])
    for limit in (100, 10_000):
        found = exact_quantiles(df, ["a"], [0.5, 0.9], buffer_values=limit)["a"]
        np.testing.assert_allclose(found, expected)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_many_buckets(spark, descending):
    df = spark.range(2000).select((F.col("id") * 37 % 2003).cast("double").alias("v"),
                                  (F.col("id") % 7).alias("n"))
    rows = running_totals(df, "v", ["n"], descending, bucket_rows=150).collect()
    rows = sorted(rows, key=lambda r: -r["v"] if descending else r["v"])
    assert [r["n_run"] for r in rows] == list(np.cumsum([r["n"] for r in rows]))


def test_auc_counts_ties_half(spark):
    tied = spark.createDataFrame([(1, 0.3), (0, 0.3), (1, 0.3), (0, 0.3)], "y int, s double")
    assert roc_auc(tied, F.col("y") == 1, "s").first()["roc_auc"] == 0.5
    rng = np.random.default_rng(3)
    rows = [(int(rng.random() < 0.4), float(rng.integers(0, 30)) / 30) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert roc_auc(df, F.col("y") == 1, "s").first()["roc_auc"] == pytest.approx(wins)
    curve = score_curve(df, F.col("y") == 1, "s")
    cuts = sorted({s for _, s in rows}, reverse=True)
    expected, before = 0.0, 0.0
    for cut in cuts:
        tp = sum(s >= cut for s in pos)
        recall = tp / len(pos)
        expected += (recall - before) * tp / sum(s >= cut for _, s in rows)
        before = recall
    assert average_precision(curve).first()[0] == pytest.approx(expected)


def test_held_out_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(12)
    n = 3000
    a = rng.normal(size=n) * 10.0 ** rng.integers(-3, 9, n)
    b = np.where(rng.random(n) < 0.6, 7.0, rng.integers(0, 50, n))  # one value in most rows
    c = np.full(n, np.nan)
    c[:5] = [1.0, np.inf, -np.inf, 2.0, 1e308]
    d = np.where(rng.random(n) < 0.5, -1.7e308, 1.7e308)
    folds = rng.integers(0, 4, n)
    rows = [(int(f), *(None if rng.random() < 0.1 else float(v) for v in vs)) for f, *vs in zip(folds, a, b, c, d)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, d double").withColumn(
        "empty", F.lit(None).cast("double")).withColumn("e f", F.col("b").cast("int"))
    names, shares = ["a", "b", "c", "d", "empty", "e f"], [0.0, 0.25, 0.5, 0.9, 1.0]
    for cells in (8, 1024):
        got = exact.held_out_quantiles(df, names, shares, "fold", cells)
        assert set(got) == {None, 0, 1, 2, 3}
        for left_out, found in got.items():
            for j, name in enumerate(names[:4]):
                kept = np.array([r[j + 1] for r in rows if r[0] != left_out and r[j + 1] is not None])
                kept = kept[np.isfinite(kept)]
                if name == "d":
                    assert set(found[name]) <= {-1.7e308, 1.7e308, 0.0}
                elif len(kept):
                    np.testing.assert_allclose(found[name], np.quantile(kept, shares), rtol=1e-12)
                else:
                    assert found[name] == [None] * 5
            assert found["empty"] == [None] * 5 and found["e f"][2] == 7.0
    assert exact.held_out_quantiles(df.limit(0), ["a"], [0.5], "fold") == {None: {"a": [None]}}
    assert exact.held_out_quantiles(df, [], [0.5], "fold") == {None: {}}


def test_an_outlier_in_the_test_fold_changes_no_training_median(spark):
    rows = [(i % 3, float(i)) for i in range(30)]
    plain = exact.held_out_quantiles(spark.createDataFrame(rows, "fold int, v double"), ["v"], [0.5], "fold")
    moved = [(f, 1e9 if f == 1 else v) for f, v in rows]
    other = exact.held_out_quantiles(spark.createDataFrame(moved, "fold int, v double"), ["v"], [0.5], "fold")
    assert plain[1] == other[1] and plain[0] != other[0] and plain[None] != other[None]


def test_held_out_counts_pass_on_in_parts(spark, monkeypatch):
    """A task groups its rows before the shuffle and never holds all its counts."""
    df = spark.createDataFrame(
        [(i % 3, float(i * 37 % 1000), -0.5 * i) for i in range(1000)],
        "fold int, v double, w double")
    whole = exact.held_out_quantiles(df, ["v", "w"], [0.1, 0.5], "fold")
    monkeypatch.setattr(exact, "HELD_COUNTS", 3)
    assert exact.held_out_quantiles(df, ["v", "w"], [0.1, 0.5], "fold") == whole
    assert whole[None]["v"] == pytest.approx(list(np.quantile(range(1000), [0.1, 0.5])))


def test_only_values_inside_a_bracket_become_rows(spark, monkeypatch):
    made, explode = [], F.explode
    monkeypatch.setattr(exact.F, "explode", lambda c: made.append(str(c)) or explode(c))
    values = [float(i * 7919 % 5000) for i in range(5000)] + [float("inf"), float("-inf")]
    rows = [(v, -v if i % 3 else None) for i, v in enumerate(values)] + [(float("nan"), None)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = exact.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.9], buffer_values=100)
    assert found == exact.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.9])
    assert len(made) == 1 and "filter" in made[0].lower()
