"""The end-to-end run: inputs to scored, ranked and stored targets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks import fixedvalues as fv
from lodeworks.functions.geochem import scaled_label
from lodeworks.models.attribution import attribution_impact
from lodeworks.models.ensemble import (
    Ensemble, importances, score, train_ensemble,
)
from lodeworks.models.folds import grouped_folds, hashed_fold, spatial_groups
from lodeworks.models.learners import HOLE_LEARNERS, selected_preparation
from lodeworks.models.store import Bundle, Registry, load_bundle, save_bundle
from lodeworks.operators.columns import (
    aligned, log_scaled, numeric_features, one_hot, without_leakage,
)
from lodeworks.operators.neighbours import idw
from lodeworks.operators.placed import focal_placed
from lodeworks.operators.polygons import join_polygons
from lodeworks.operators.raster import Raster, focal_statistics, rim_tiles
from lodeworks.operators.versions import top_ranked
from lodeworks.plans.holes import build_master, label_p95, with_place_features
from lodeworks.session import stage_table
from lodeworks.sources.sinks import write_csv, write_geojson_lines

MIN_LABELS = 10
TEACHER = "teacher_"


@dataclass
class Inputs:
    """Typed input tables of one run; only the collar is required."""

    collar: DataFrame
    assay: DataFrame | None = None
    extra: DataFrame | None = None
    extra_attributes: list[str] = field(default_factory=list)
    alteration: DataFrame | None = None
    pixels: DataFrame | None = None
    rasters: list[Raster] = field(default_factory=list)
    #: placements of the rasters; without it they are all in degrees and not rotated
    catalogue: DataFrame | None = None
    layer: DataFrame | None = None
    layer_attributes: list[str] = field(default_factory=list)


@dataclass
class RunResult:
    status: str
    deposit: str
    metrics: dict = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    labelled: int = 0
    scored: DataFrame | None = None
    top_targets: DataFrame | None = None
    bundle: Bundle | None = None


def hole_features(inputs: Inputs, neighbours: int = fv.NEIGHBOURS) -> DataFrame:
    """Staged master table with raster, interpolation and place features."""
    if inputs.assay is not None:
        master = build_master(
            inputs.collar, inputs.assay, inputs.extra, inputs.extra_attributes,
            inputs.alteration)
    else:
        master = inputs.collar
    if "deposit" not in master.columns:
        master = master.withColumn("deposit", F.lit(None).cast("string"))
    master = stage_table(master, "master")
    placed = master.select("hole_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    extra = []
    if inputs.pixels is not None and inputs.rasters:
        extra.append(raster_windows(placed, inputs, "hole_id"))
    if inputs.layer is not None:
        extra.append(geology_levels(placed, inputs.layer, inputs.layer_attributes))
    if "treo_max" in master.columns:
        sites = master.filter("treo_max IS NOT NULL").select(
            F.col("hole_id").alias("site_id"), F.col("lon").alias("x"),
            F.col("lat").alias("y"), "treo_max")
        pseudo = idw(placed, sites, ["treo_max"], neighbours, prefix="pseudo_")
        extra.append(pseudo.select(
            "hole_id", F.col("pseudo_treo_max").alias("pseudo_treo"), "idw_conf"))
    for table in extra:
        master = master.join(table, "hole_id", "left")
    return stage_table(with_place_features(master), "hole-features")


def raster_windows(points: DataFrame, inputs: Inputs, key: str) -> DataFrame:
    """``key`` and mean, std and max of the 3 x 3 pixels of each raster as columns.

    0 outside a raster and without any valid pixel; points without a place have no row.
    """
    ids = [r.raster_id for r in inputs.rasters]
    at = points.select(key, "x", "y")
    if inputs.catalogue is None:
        stats = focal_statistics(at, inputs.pixels, inputs.rasters)
    else:
        stats = focal_placed(at, rim_tiles(inputs.pixels), inputs.catalogue)
    names = ("mean", "std", "max")
    wide = stats.groupBy(key).pivot("raster_id", ids).agg(*[F.max(s).alias(s) for s in names])
    wide = wide.select(key, *[F.col(f"`{i}_{s}`").alias(f"r_{i}_{s}") for i in ids for s in names])
    located = at.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select(key)
    return located.join(wide, key, "left").fillna(0.0)


def geology_levels(
    points: DataFrame, layer: DataFrame, attributes: list[str], key: str = "hole_id",
) -> DataFrame:
    """``key`` and 0/1 columns for the levels of the polygons' attributes.

    Letters and digits of a level make its column's name; levels that give one name share it.
    """
    found = join_polygons(points, layer, key, attributes).drop("x", "y")
    plain = [
        F.regexp_replace(F.coalesce(f"geol_{a}", F.lit("unknown")), "[^A-Za-z0-9]+", "_").alias(f"geol_{a}")
        for a in attributes]
    levels = stage_table(found.select(key, *plain), "geology")
    for a in attributes:
        levels = one_hot(levels, f"geol_{a}")
    return levels.drop(*[f"geol_{a}" for a in attributes])


def model_inputs(
    master: DataFrame, features: list[str], teachers: list[Bundle] = (),
) -> DataFrame:
    """hole_id, deposit, place, raw treo and model features; missing values stay NULL.

    The same function serves training and scoring, and looks at one row at a time: medians
    are fitted by the preparation within each training fold and stored with the model, so a
    hole scores the same alone and in a batch. ``teachers`` are the model whose scores are
    features, the one whose scores are features of that model, and so on.
    """
    if "treo_max" in features:
        raise ValueError("the target is no feature")
    have = [c for c in features if c in master.columns]
    treo = F.col("treo_max") if "treo_max" in master.columns else F.lit(None)
    keep = log_scaled(master, have).withColumn("treo_raw", treo.cast("double"))
    if teachers:
        lesson = score(
            teachers[0].ensemble,
            model_inputs(master, teachers[0].ensemble.features, teachers[1:]), ["hole_id"])
        keep = keep.join(lesson.select("hole_id", F.col("prospectivity").alias(f"{TEACHER}prospectivity"), *[
            F.col(n).alias(f"{TEACHER}{n}") for n in teachers[0].ensemble.names]), "hole_id", "left")
    return aligned(keep, features, ["hole_id", "deposit", "lon", "lat", "treo_raw"])


def teacher_features(bundle: Bundle) -> list[str]:
    return [f"{TEACHER}prospectivity", *[f"{TEACHER}{n}" for n in bundle.ensemble.names]]


def training_frame(inputs: DataFrame, p95: float, spatial: bool = True) -> DataFrame:
    """Labelled rows with label ``y`` and a ``fold`` that keeps neighbours together."""
    labelled = inputs.filter("treo_raw IS NOT NULL").withColumn(
        "y", scaled_label(F.col("treo_raw"), p95))
    if spatial:
        return stage_table(grouped_folds(spatial_groups(labelled)), "training")
    return stage_table(
        labelled.withColumn("fold", hashed_fold(F.col("hole_id"), 5)), "training")


def run(
    spark: SparkSession, inputs: Inputs, deposit: str, root: str, mode: str = "train",
    force_retrain: bool = False, teach: bool = False, learners: dict | None = None,
    prepare: Callable = selected_preparation, drop_target_components: bool = False,
    status: Callable[[str], None] = lambda message: None,
) -> RunResult:
    """Train on, or only score, one deposit; results and models go below ``root``.

    ``mode`` is ``train`` or ``infer``. Training widens its features by those of
    the stored model unless ``force_retrain``; ``teach`` adds that model's
    scores as features.
    """
    if mode not in ("train", "infer"):
        raise ValueError("mode is train or infer")
    if mode == "infer" and force_retrain:
        raise ValueError("scoring only and retraining exclude each other")
    registry = Registry(spark, root)
    status("building hole features")
    master = hole_features(inputs)
    bundle = None if force_retrain else registry.latest_bundle()
    if mode == "infer":
        if bundle is None:
            return RunResult("error: no trained model", deposit)
        status("scoring")
        scored = _scored(master, bundle.ensemble, _teachers(spark, registry, bundle))
        return _finished(spark, root, deposit, "success", scored, bundle, 0)
    features = without_leakage(numeric_features(master), drop_target_components)
    teachers = [bundle, *_teachers(spark, registry, bundle)] if teach and bundle else []
    if bundle is not None:
        known = [f for f in bundle.ensemble.features if not f.startswith(TEACHER)]
        features = sorted(set(features) | set(known))
    if teachers:
        features = features + teacher_features(bundle)
    labelled = 0
    if "treo_max" in master.columns:
        labelled = master.filter("treo_max IS NOT NULL").count()
    if labelled < MIN_LABELS:
        return RunResult("insufficient_data", deposit, labelled=labelled)
    status("training")
    p95 = label_p95(master)
    rows = stage_table(model_inputs(master, features, teachers), "model-inputs")
    frame = training_frame(rows, p95)
    ensemble, _ = train_ensemble(
        frame, features, "y", learners or HOLE_LEARNERS, prepare=prepare)
    stored = save_bundle(
        spark, root, deposit, ensemble, frame.drop("y", "fold", "group"), p95, [deposit],
        bundle if teachers else None)
    registry.register(stored)
    status("scoring")
    return _finished(
        spark, root, deposit, "success",
        _join_scores(master, score(ensemble, rows, ["hole_id"])), stored, labelled)


def _teachers(spark, registry: Registry, bundle: Bundle) -> list[Bundle]:
    """The model whose scores are features of this one, that model's own, and so on."""
    chain = []
    while any(f.startswith(TEACHER) for f in bundle.ensemble.features):
        row = registry.table().filter(F.col("version") == bundle.info["previous_version"]).first()
        bundle = load_bundle(spark, row["model_path"])
        chain.append(bundle)
    return chain


def _scored(master: DataFrame, ensemble: Ensemble, teachers: list[Bundle]) -> DataFrame:
    rows = model_inputs(master, ensemble.features, teachers)
    return _join_scores(master, score(ensemble, rows, ["hole_id"]))


def _join_scores(master: DataFrame, scores: DataFrame) -> DataFrame:
    return master.join(scores.select("hole_id", "prospectivity", "score_100"), "hole_id", "left")


def _finished(spark, root, deposit, status, scored, bundle: Bundle, labelled: int) -> RunResult:
    """Scores as Parquet, as CSV and as GeoJSON features, one a line."""
    out = f"{root.rstrip('/')}/scored/{deposit}/{bundle.info['version']}"
    scored.withColumn("deposit", F.lit(deposit)).write.mode("overwrite").parquet(out)
    stored = spark.read.parquet(out)
    write_csv(stored, f"{root.rstrip('/')}/scored_csv/{deposit}/{bundle.info['version']}")
    write_geojson_lines(stored, f"{root.rstrip('/')}/scored_geojson/{deposit}/{bundle.info['version']}")
    return RunResult(
        status, deposit, bundle.ensemble.metrics, bundle.ensemble.features, labelled, stored,
        top_ranked(stored, "score_100", "hole_id", fv.TOP_TARGETS), bundle)


def explain(result: RunResult, rows: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Importances, and the features of greatest mean absolute attribution."""
    ensemble = result.bundle.ensemble
    return importances(ensemble), attribution_impact(ensemble, rows, top=top)


def retrain(
    spark: SparkSession, root: str, deposit: str, inputs: Inputs,
    learners: dict | None = None, prepare: Callable = selected_preparation,
) -> RunResult:
    """Add labelled holes to the stored training rows and refit everything.

    A hole seen before is replaced by its new row. Labels are scaled once over
    the union, from stored raw grades.
    """
    registry = Registry(spark, root)
    bundle = registry.latest_bundle()
    if bundle is None:
        return RunResult("error: no trained model", deposit)
    features = [f for f in bundle.ensemble.features if not f.startswith(TEACHER)]
    fresh = stage_table(
        model_inputs(hole_features(inputs), features).filter("treo_raw IS NOT NULL")
        .withColumn("deposit", F.lit(deposit)), "new-rows")
    if fresh.isEmpty():
        return RunResult("insufficient_data", deposit)
    old = bundle.training_rows(spark).select("hole_id", "deposit", "lon", "lat", "treo_raw",
                                             *features)
    kept = old.join(fresh.select("hole_id", "deposit"), ["hole_id", "deposit"], "left_anti")
    union = stage_table(kept.unionByName(fresh, allowMissingColumns=True), "union-rows")
    p95 = label_p95(union, "treo_raw")
    frame = training_frame(union, p95)
    ensemble, _ = train_ensemble(
        frame, features, "y", learners or HOLE_LEARNERS, prepare=prepare)
    deposits = list(dict.fromkeys([*bundle.info["deposits"], deposit]))
    stored = save_bundle(
        spark, root, deposit, ensemble, frame.drop("y", "fold", "group"), p95, deposits, bundle)
    registry.register(stored)
    return RunResult("success", deposit, ensemble.metrics, features, frame.count(),
                     bundle=stored)


def retrain_mode(registry: Registry, deposit: str) -> str:
    """Whether a retrain updates a known deposit or adds a new one."""
    return "update_deposit" if deposit in registry.deposits() else "new_deposit"


def score_grid(
    ensemble: Ensemble, grid: DataFrame, names: dict[str, str]
) -> DataFrame:
    """Score a prediction grid; ``names`` maps grid columns to model features."""
    renamed = grid.withColumnsRenamed(names)
    return score(ensemble, renamed, ["cell_id", "grow", "gcol", "lon", "lat"])


def shared_features(grid_columns: list[str], features: list[str]) -> list[str]:
    """Features a grid and the holes have in common, in grid order."""
    return [c for c in grid_columns if c in set(features)]


def run_report(result: RunResult, k: int = 5) -> DataFrame:
    """One row of metrics and counts with the k best targets as an array."""
    best = top_ranked(result.scored, "score_100", "hole_id", k)
    targets = F.sort_array(F.collect_list(F.struct("rank", "hole_id", "lon", "lat", "score_100")))
    m = result.metrics
    return best.agg(
        targets.alias("targets"), F.max("score_100").alias("top_score")
    ).select(
        F.lit(result.deposit).alias("deposit"), F.lit(result.status).alias("status"),
        F.lit(result.labelled).alias("n_labelled"),
        F.lit(len(result.features)).alias("n_features"),
        *[F.round(F.lit(m[n]).cast("double"), 4).alias(n) for n in ("cv_r2", "roc_auc", "rmse")],
        F.lit(m["confidence"]).alias("confidence"), "top_score", "targets",
    )
