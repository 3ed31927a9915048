"""Feature assembly for prediction grids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.geochem import centroid_distance, range_scaled
from lodeworks.models.ensemble import train_ensemble
from lodeworks.models.learners import GRID_LEARNERS, component_preparation
from lodeworks.operators.columns import numeric_features, without_leakage
from lodeworks.operators.exact import exact_quantiles
from lodeworks.operators.grid import band_areas, grid_points, grid_spec
from lodeworks.operators.neighbours import idw
from lodeworks.operators.raster import Raster, raster_features, sample_pixels
from lodeworks.plans.holes import label_p95
from lodeworks.plans.prospect import (
    MIN_LABELS, Inputs, geology_levels, hole_features, model_inputs, raster_windows, score_grid,
    shared_features, training_frame,
)
from lodeworks.session import stage_table
from lodeworks.sources.sinks import write_csv


def grid_features(
    master: DataFrame, pixels: DataFrame | None, rasters: list[Raster], grades: list[str],
    treo: str = "treo_max", resolution_m: float = 10.0,
) -> DataFrame:
    """Prediction grid with raster values, interpolated grades and place features.

    ``master`` is one row per hole and should be staged. All grades, the
    confidence and the distance to the nearest labelled hole come from one
    neighbour search.
    """
    points = grid_places(master, resolution_m)
    sites = master.filter(F.col(treo).isNotNull()).select(
        F.col("hole_id").alias("site_id"), F.col("lon").alias("x"), F.col("lat").alias("y"),
        *grades,
    )
    features = idw(points, sites, grades)
    if rasters:
        at = points.select("cell_id", "x", "y")
        samples = stage_table(sample_pixels(at, pixels, rasters), "grid-samples")
        layers = raster_features(at, samples, "cell_id", rasters, "g_")
        features = features.join(layers, "cell_id", "left")
    return with_hole_places(features, master).drop("x", "y")


def grid_places(master: DataFrame, resolution_m: float) -> DataFrame:
    """Points of a grid over the holes' extent, with x and y."""
    points = grid_points(master.sparkSession, grid_spec(master, resolution_m))
    return points.withColumns({"x": F.col("lon"), "y": F.col("lat")})


def with_hole_places(points: DataFrame, master: DataFrame) -> DataFrame:
    """Place features of points by the extent and the centre of the holes."""
    lon, lat = F.col("lon"), F.col("lat")
    centre = exact_quantiles(master, ["lon", "lat"], [0.5])
    extent = master.agg(
        F.min("lon").alias("lon0"), F.max("lon").alias("lon1"),
        F.min("lat").alias("lat0"), F.max("lat").alias("lat1"),
    ).first()
    return points.withColumns({
        "coord_lon_norm": range_scaled(lon, extent["lon0"], extent["lon1"]),
        "coord_lat_norm": range_scaled(lat, extent["lat0"], extent["lat1"]),
        "dist_centroid": centroid_distance(lon, lat, centre["lon"][0], centre["lat"][0]),
    })


@dataclass
class GridResult:
    """Scored grid, the share of each band, and the model's features and metrics."""

    status: str
    scored: DataFrame | None = None
    bands: DataFrame | None = None
    features: list[str] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)


def run_grid(
    spark: SparkSession, inputs: Inputs, deposit: str, root: str, resolution_m: float = 10.0,
    learners: dict | None = None,
) -> GridResult:
    """Train on the features that holes and places share, and score a grid over the holes.

    Those are the raster windows, geology levels and place features; they are worked out by the
    same functions for both. The grid goes below ``root`` as Parquet and CSV.
    """
    master = hole_features(inputs)
    labelled = master.filter("treo_max IS NOT NULL").count() if "treo_max" in master.columns else 0
    if labelled < MIN_LABELS:
        return GridResult("insufficient_data")
    points = grid_places(master, resolution_m)
    grid = with_hole_places(points, master)
    if inputs.pixels is not None and inputs.rasters:
        grid = grid.join(raster_windows(points, inputs, "cell_id"), "cell_id", "left")
    if inputs.layer is not None:
        grid = grid.join(
            geology_levels(points, inputs.layer, inputs.layer_attributes, "cell_id"), "cell_id", "left")
    grid = stage_table(grid.drop("x", "y"), "grid")
    features = shared_features(grid.columns, without_leakage(numeric_features(master)))
    p95 = label_p95(master)
    frame = training_frame(model_inputs(master, features), p95)
    ensemble, _ = train_ensemble(
        frame, features, "y", learners or GRID_LEARNERS, prepare=component_preparation)
    out = f"{root.rstrip('/')}/grid/{deposit}"
    score_grid(ensemble, grid, {}).write.mode("overwrite").parquet(out)
    scored = spark.read.parquet(out)
    write_csv(scored, f"{root.rstrip('/')}/grid_csv/{deposit}")
    return GridResult(
        "success", scored, band_areas(scored, "prospectivity", resolution_m), features, ensemble.metrics)
