"""Folds, stacker, leakage rules and the end-to-end run with its store."""

import math
import random
import threading

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lodeworks.models import ensemble, folds, learners
from lodeworks.models.store import Registry, is_compatible, load_bundle
from lodeworks.operators import columns
from lodeworks.operators.metrics import linear_impact
from lodeworks.operators.versions import content_hash, top_ranked
from lodeworks.plans import prospect
from lodeworks.plans.prospect import (
    Inputs, explain, retrain, retrain_mode, run, run_report, training_frame,
)
from lodeworks.sources.tables import view

LIGHT = {
    "gb": learners.Boosted(rounds=3, depth=3), "rf": learners.Forest(trees=5, depth=4),
    "sgd": learners.RobustLinear(iterations=20),
}


def test_balanced_folds():
    assert folds.balanced_folds({"a": 5, "b": 4, "c": 3, "d": 2, "e": 1}, 2) == {
        "a": 0, "b": 1, "c": 1, "d": 0, "e": 0}


def test_turns_equal_the_greedy_result():
    rng = np.random.default_rng(2)
    for _ in range(300):
        sizes = {f"g{i:03d}": int(n) for i, n in enumerate(rng.choice(
            [1, 2, 3, 7, 40, 500], rng.integers(2, 60), p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05]))}
        k = int(rng.integers(2, 6))
        load, found = [0] * k, {}
        for size in sorted(set(sizes.values()), reverse=True):
            names = sorted(g for g, n in sizes.items() if n == size)
            turns = folds.class_turns(load, size, len(names))
            assert len(turns) <= k + 1
            for rank, g in enumerate(names):
                turn = [t for t in turns if t.start <= rank][-1]
                found[g] = turn.order[(rank - turn.start) % len(turn.order)]
        assert found == folds.balanced_folds(sizes, k)


def test_a_million_groups_are_dealt_like_the_greedy_result(spark):
    n = 1_000_000
    size = F.when(F.col("id") < 3, 200_000).when(F.col("id") % 1000 == 0, 30).when(F.col("id") % 7 == 0, 2).otherwise(1)
    sizes = spark.range(n).select(F.format_string("g%07d", "id").alias("group"), size.cast("long").alias("n"))
    got = {r["group"]: r["fold"] for r in folds._folds_of_groups(sizes, "group", 5).collect()}
    assert got == folds.balanced_folds({r["group"]: r["n"] for r in sizes.collect()}, 5)


def test_listed_and_joined_groups_agree(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 50 != 0, F.concat(F.lit("g"), F.col("id") % 37)).alias("group"))
    one, two = ({r["id"]: r["fold"] for r in folds.grouped_folds(df, listed=n).collect()} for n in (1000, 5))
    assert one == two and len(one) == 3000 and one[50] is None


def test_few_holes_stand_alone(spark):
    df = spark.createDataFrame([(str(i), float(i), 1.0) for i in range(6)],
                               "hole_id string, lon double, lat double")
    grouped = folds.grouped_folds(folds.spatial_groups(df))
    assert grouped.select("group").distinct().count() == 6
    assert grouped.select("fold").distinct().count() == 5
    with pytest.raises(ValueError):
        folds.grouped_folds(df.withColumn("group", F.lit("one")))


def test_spatial_groups_stay_whole(spark):
    rng = np.random.default_rng(0)
    rows = [(f"h{i}", float(rng.random()), float(rng.random())) for i in range(60)]
    rows += [("lost", None, None)]
    df = spark.createDataFrame(rows, "hole_id string, lon double, lat double")
    out = folds.grouped_folds(folds.spatial_groups(df))
    assert out.count() == 61
    assert out.groupBy("group").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.random((80, 3))
    y = x @ [0.5, -0.2, 0.9] + 0.1 * rng.normal(size=80)
    df = spark.createDataFrame(
        [tuple(map(float, (*a, b))) for a, b in zip(x, y)],
        "a double, b double, c double, y double")
    model = ensemble.ridge(df, ["a", "b", "c"], "y", 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(model.coefficients.toArray(), w, rtol=1e-9)
    assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ w)


def test_quality_gate():
    assert ensemble.qualified({"rf": 0.4, "gb": -9.0}) == ["rf"]
    assert ensemble.qualified({"rf": -7.0, "gb": -9.0}) == ["rf"]


def test_leakage_and_alignment(spark):
    names = ["treo_max", "Lree_mean", "idw_conf", "ceo2_ppm_max", "r_tmi", "r_tmi"]
    assert columns.without_leakage(names) == ["ceo2_ppm_max", "r_tmi"]
    assert columns.without_leakage(names, drop_target_components=True) == ["r_tmi"]
    df = spark.createDataFrame([(1, 2.0)], "b int, id double")
    out = columns.aligned(df, ["a", "b"], ["id"])
    assert out.columns == ["id", "a", "b"] and tuple(out.first()) == (2.0, 0.0, 1.0)


def test_imputation_inside_the_preparation(spark):
    rows = [(1.0, 0.1), (2.0, 0.2), (4.0, 0.2), (8.0, 0.9), (None, 0.5),
            (float("nan"), 0.4), (float("inf"), 0.3)]
    df = spark.createDataFrame(rows, "a double, y double")
    clean = columns.imputed(df, {"a": 3.0})
    assert [r["a"] for r in clean.collect()] == [1.0, 2.0, 4.0, 8.0, 3.0, 3.0, 0.0]
    train = df.filter("y < 1 AND a IS NOT NULL AND NOT isnan(a) AND a < 100")
    prepared = learners.selected_preparation(train, ["a"], "y", 4).transform(df)
    assert [r["in_a"] for r in prepared.collect()] == [1.0, 2.0, 4.0, 8.0, 3.0, 3.0, 3.0]


def test_linear_impact(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, b double")
    rows = linear_impact(df, {"a": -3.0, "b": 5.0}).collect()
    assert {r["feature"]: r["impact"] for r in rows} == {"a": 3.0, "b": 0.0}


def test_component_learners(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{i}", float(a), float(b), float(np.clip(a * a + b / 4, 0, 1)))
            for i, (a, b) in enumerate(rng.random((60, 2)))]
    df = spark.createDataFrame(rows, "hole_id string, a double, b double, y double")
    frame = df.withColumn("fold", folds.hashed_fold(F.col("hole_id"), 3))
    models = {"rf": learners.Forest(5, 3, 3, "sqrt", 0.8),
              "svm": learners.RandomFourier(components=25)}
    fitted, stacked = ensemble.train_ensemble(
        frame, ["a", "b"], "y", models, prepare=learners.component_preparation)
    assert stacked.count() == 60 and stacked.select("hole_id").distinct().count() == 60
    assert fitted.metrics["model_scores"]["svm"] > 0.5
    scores = ensemble.score(fitted, df, ["hole_id"])
    assert scores.filter("score_100 < 0 OR score_100 > 100").isEmpty()


def test_train_score_retrain(spark, tmp_path):
    root = str(tmp_path)
    collar = view(spark, SMALL, "collar")
    assay = view(spark, SMALL, "assay")
    first = Inputs(collar.filter("deposit <> 'd4'"), assay)
    later = Inputs(collar.filter("deposit = 'd4'"), assay)
    nothing = run(spark, first, "west", root, mode="infer")
    assert nothing.status.startswith("error")
    said = []
    result = run(spark, first, "west", root, learners=LIGHT, status=said.append)
    assert result.status == "success" and "training" in said
    assert result.scored.count() == first.collar.count()
    assert result.scored.filter("score_100 NOT BETWEEN 0 AND 100").isEmpty()
    assert not any(columns.reveals_target(f) for f in result.features)
    assert result.top_targets.count() == 50
    report = run_report(result).first()
    assert len(report["targets"]) == 5 and report["top_score"] == report["targets"][0]["score_100"]
    leading, impact = explain(result, training_rows(result), top=2)
    assert leading.count() <= 15 and impact.count() == 2

    again = load_bundle(spark, result.bundle.path)
    assert is_compatible(again, result.features) and not is_compatible(again, ["x"])
    scored = run(spark, later, "east", root, mode="infer")
    assert scored.scored.count() == later.collar.count()

    registry = Registry(spark, root)
    assert retrain_mode(registry, "east") == "new_deposit"
    updated = retrain(spark, root, "east", later, learners=LIGHT)
    info = updated.bundle.info
    assert list(info["deposits"]) == ["west", "east"]
    assert info["delta_holes"] == updated.labelled - result.labelled > 0
    assert registry.deposits() == ["east", "west"]
    assert registry.latest_path("west") == result.bundle.path
    assert registry.latest_path("unknown") == updated.bundle.path
    registry.set_global(result.bundle.info["version"])
    assert registry.latest_path() == result.bundle.path
    with pytest.raises(ValueError):
        run(spark, later, "east", root, mode="infer", force_retrain=True)


def test_a_hole_scores_the_same_alone_and_in_a_batch(spark, tmp_path):
    """Missing values are filled by what the stored model learnt; taught models score alike."""
    root = str(tmp_path)
    inputs = Inputs(view(spark, SMALL, "collar"), view(spark, SMALL, "assay"))
    light = {"rf": learners.Forest(trees=4, depth=3), "sgd": learners.RobustLinear(iterations=10)}
    for teach in (False, True, True):  # the last model's teacher has a teacher
        result = run(spark, inputs, "west", root, learners=light, teach=teach)
    assert sum(f.startswith("teacher_") for f in result.features) == 3
    registry = Registry(spark, root)
    chain = prospect._teachers(spark, registry, result.bundle)
    assert [len(chain), any(f.startswith("teacher_") for f in chain[-1].ensemble.features)] == [2, False]
    master = prospect.hole_features(inputs)
    assert master.filter("elevation IS NULL OR treo_max IS NULL").count() > 0
    batch = {r["hole_id"]: r["prospectivity"] for r in prospect._scored(master, result.bundle.ensemble, chain).collect()}
    stored = {r["hole_id"]: r["prospectivity"] for r in result.scored.collect()}
    assert batch == pytest.approx(stored)
    odd = master.filter("treo_max IS NULL").limit(2).collect() + master.limit(1).collect()
    for r in odd:
        alone = prospect._scored(master.filter(F.col("hole_id") == r["hole_id"]), result.bundle.ensemble, chain)
        assert alone.first()["prospectivity"] == pytest.approx(batch[r["hole_id"]])
    row = master.limit(1).select("hole_id", "deposit", "lon", "lat", F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b"))
    assert prospect.model_inputs(row, ["a", "b", "c"]).first()[-3:] == (1.0, None, 0.0)


def training_rows(result):
    rows = result.bundle.training_rows(result.scored.sparkSession)
    return training_frame(rows, result.bundle.info["p95"], spatial=False)


def test_too_few_labels(spark, tmp_path):
    collar = view(spark, SMALL, "collar").limit(30)
    assay = view(spark, SMALL, "assay").filter("hole_id = '1'")
    assert run(spark, Inputs(collar, assay), "x", str(tmp_path)).status == "insufficient_data"


def test_hash_ignores_row_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    one = content_hash(df, ["id", "v"]).first()
    assert one == content_hash(df.orderBy(F.col("id").desc()), ["id", "v"]).first()
    assert one != content_hash(df.filter("id <> 5"), ["id", "v"]).first()


def test_top_ranked_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", None)], "id string, s double")
    rows = top_ranked(df, "s", "id", 2).collect()
    assert [(r["id"], r["rank"]) for r in rows] == [("a", 1), ("b", 2)]


def test_permutation_impacts_score_all_features_in_one_pass(spark, monkeypatch):
    """Equal to a score per feature; the plan does not grow with the features, nothing is broadcast."""
    passes = []

    def score(fitted, df, keep):
        passes.append(keep)
        return df.select(*keep, (F.col("a") + 2 * F.col("b")).alias("prospectivity"))

    monkeypatch.setattr(ensemble, "score", score)
    fitted = ensemble.Ensemble(["a", "b", "c d"], None, {}, None)
    rows = [(f"h{i}", float(i * 7 % 40), float(i % 5), 1.0) for i in range(40)]
    rows += [("h3", 1.0, 0.0, 2.0), (None, 5.0, 1.0, 0.0)]  # a key that comes twice, and none
    df = spark.createDataFrame(rows, "hole_id string, a double, b double, `c d` double")
    features = ["a", "b", "c d"]
    found = ensemble.permutation_impact(fitted, df, "y", features)
    got = {r["feature"]: r["impact"] for r in found.collect()}
    assert len(passes) == 2
    assert found._jdf.queryExecution().optimizedPlan().toString().count("] parquet") == 1
    dealt = ensemble._exchanged(df, features, "hole_id").collect()
    assert sorted(r["_dealt"]["d0"] for r in dealt) == sorted(r[1] for r in rows)
    before = {}
    for key, a, b, _ in rows:
        before.setdefault(key, []).append(a + 2 * b)
    for i, name in enumerate(features):
        changes = [
            abs((r["_dealt"]["d0"] if i == 0 else r["a"]) + 2 * (r["_dealt"]["d1"] if i == 1 else r["b"]) - was)
            for r in dealt if r["hole_id"] is not None for was in before[r["hole_id"]]]
        assert got[name] == pytest.approx(np.mean(changes))
    empty = ensemble.permutation_impact(fitted, df.limit(0), "y", features).collect()
    assert [(r["feature"], r["impact"]) for r in empty] == [(c, None) for c in features]


def test_all_models_are_fitted_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"h{i}", float(a), float(np.clip(a, 0, 1)), i % 2) for i, a in enumerate(rng.random(40))]
    frame = spark.createDataFrame(rows, "hole_id string, a double, y double, fold int")
    # two learners of two folds and of all rows meet here, or the wait ends in an error
    meeting, fit = threading.Barrier(6, timeout=60), ensemble.fitted_learner

    def met(*args):
        meeting.wait()
        return fit(*args)

    monkeypatch.setattr(ensemble, "fitted_learner", met)
    models = {"rf": learners.Forest(3, 3, 1), "sgd": learners.RobustLinear(iterations=20)}
    fitted, stacked = ensemble.train_ensemble(frame, ["a"], "y", models)
    assert fitted.names == ["rf", "sgd"] and stacked.count() == 40


def test_waves_are_cosines_of_drawn_directions(spark):
    rows = [(0.25, -1.5), (-2.0, 0.5), (3.0, 4.0)]
    df = spark.createDataFrame(rows, "sc_a double, sc_b double")
    out = df
    for stage in learners._fourier_stages(df, ["a", "b"], 7):
        out = stage.transform(out)
    spread = (2.0 / (2 * np.var(rows))) ** 0.5
    draw = random.Random(learners.SEED)
    directions = np.array([[draw.gauss(0.0, spread) for _ in range(2)] for _ in range(7)])
    shifts = np.array([draw.uniform(0.0, 2 * math.pi) for _ in range(7)])
    wanted = (2 / 7) ** 0.5 * np.cos(np.array(rows) @ directions.T + shifts)
    assert np.allclose([r["fourier"].toArray() for r in out.collect()], wanted, rtol=0, atol=1e-12)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "zip_with(" not in plan
