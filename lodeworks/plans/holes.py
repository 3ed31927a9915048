"""Composed jobs on holes: master table, labelled slice, feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks import fixedvalues as fv
from lodeworks.functions.geochem import (
    centroid_distance, depth_score, label_scale, range_scaled, scaled_label,
)
from lodeworks.operators.columns import (
    imputed, log_scaled, matrix_columns, medians, numeric_features, one_hot, without_leakage,
)
from lodeworks.operators.exact import exact_quantiles, quantile
from lodeworks.operators.holes import (
    add_interval_totals, alteration_counts, alteration_flags, hole_aggregates, hole_master,
    pivot_attributes,
)
from lodeworks.operators.polygons import join_polygons
from lodeworks.session import stage_table


def build_master(
    collar: DataFrame, assay: DataFrame, extra: DataFrame | None = None,
    extra_attributes: list[str] = (), alteration: DataFrame | None = None,
    ladder: str = "hole",
) -> DataFrame:
    """One row per hole from intervals, extra attributes and alteration text."""
    aggregates = hole_aggregates(add_interval_totals(assay))
    pivoted = pivot_attributes(extra, list(extra_attributes), "_geo") if extra is not None else None
    # Counting before the join also drops texts of unknown holes, without a
    # semi-join that would have to move every text.
    counts = alteration_counts(alteration) if alteration is not None else None
    master = hole_master(collar, aggregates, pivoted, counts)
    if "fromdepth_min" in master.columns:
        master = master.withColumn("depth_score", depth_score(F.col("fromdepth_min"), ladder))
    return master


def with_place_features(master: DataFrame) -> DataFrame:
    """Add normalised coordinates and the distance to the median centre.

    The statistics are six numbers read once; the columns are then arithmetic.
    """
    extent = master.agg(
        F.min("lon").alias("lon0"), F.max("lon").alias("lon1"),
        F.min("lat").alias("lat0"), F.max("lat").alias("lat1"),
    ).first()
    if extent["lon0"] is None:
        return master
    centre = exact_quantiles(master, ["lon", "lat"], [0.5])
    lon, lat = F.col("lon"), F.col("lat")
    return master.withColumns({
        "coord_lon_norm": range_scaled(lon, extent["lon0"], extent["lon1"]),
        "coord_lat_norm": range_scaled(lat, extent["lat0"], extent["lat1"]),
        "dist_centroid": centroid_distance(lon, lat, centre["lon"][0], centre["lat"][0]),
    })


def label_p95(master: DataFrame, treo: str = "treo_max") -> float:
    """Grade that scales labels to 0..1, with its fallbacks."""
    labelled = master.filter(F.col(treo).isNotNull())
    return label_scale(quantile(labelled, treo, 0.95), labelled.count())


def labelled_targets(collar: DataFrame, assay: DataFrame, k: int = fv.TOP_TARGETS) -> DataFrame:
    """The flagship slice: holes ranked by grade with label and depth score.

    The per-hole table is staged once; the percentile and the ranking read it.
    """
    intervals = add_interval_totals(assay).select("hole_id", "fromdepth", "treo")
    holes = intervals.groupBy("hole_id").agg(
        F.max("treo").alias("treo_max"), F.avg("treo").alias("treo_mean"),
        F.min("fromdepth").alias("fromdepth_min"),
    )
    master = stage_table(
        collar.select("hole_id", "deposit").join(holes, "hole_id", "left"), "labelled-holes"
    )
    p95 = label_p95(master)
    return (
        master.orderBy(F.col("treo_max").desc_nulls_last(), "hole_id").limit(k)
        .select(
            "hole_id", "deposit", "treo_max", "treo_mean",
            depth_score(F.col("fromdepth_min")).alias("depth_score"),
            scaled_label(F.col("treo_max"), p95).alias("y"),
        )
    )


def feature_matrix(
    master: DataFrame, drop_target_components: bool = False, log: bool = True
) -> tuple[DataFrame, list[str]]:
    """Model-ready matrix and its ordered feature names.

    ``master`` should be staged: selection, medians and the matrix read it.
    """
    features = without_leakage(numeric_features(master), drop_target_components)
    filled = imputed(master, medians(master, features))
    if log:
        filled = log_scaled(filled, features)
    return filled.select(*matrix_columns(filled.columns, features)), features


def geology_matrix(
    collar: DataFrame, assay: DataFrame, alteration: DataFrame, layer: DataFrame,
    attributes: list[str],
) -> DataFrame:
    """The staged-script matrix: flags, geology levels, scaled grade, medians filled.

    Ratios enter by their mean only, and the finer depth ladder applies.
    """
    aggregates = hole_aggregates(add_interval_totals(assay), ratios_by_mean_only=True)
    master = hole_master(collar, aggregates).join(alteration_flags(alteration), "hole_id", "left")
    placed = master.withColumns({"x": F.col("lon"), "y": F.col("lat")})
    points = placed.select("hole_id", "x", "y")
    geology = join_polygons(points, layer, "hole_id", attributes).drop("x", "y")
    master = stage_table(placed.join(geology, "hole_id", "left"), "geology-master")
    p95 = label_p95(master)
    scaled = master.withColumns({
        "depth_score": depth_score(F.col("fromdepth_min"), "matrix"),
        "treo_norm": F.coalesce(scaled_label(F.col("treo_max"), p95), F.lit(0.0)),
    })
    for attribute in attributes:
        scaled = one_hot(scaled, f"geol_{attribute}")
    features = [
        c for c in scaled.columns
        if c.endswith(("_max", "_mean", "_score", "_norm", "_min")) or c == "maxdepth"
        or c.startswith(("alt_", *[f"geol_{a}_" for a in attributes]))
    ]
    filled = imputed(scaled, medians(scaled, features))
    return filled.select(*matrix_columns(filled.columns, features))
