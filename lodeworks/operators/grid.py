"""Prediction grids, smooth surfaces, bands and map cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks import fixedvalues as fv


@dataclass(frozen=True)
class GridSpec:
    """A regular lon/lat grid: origin, steps and size."""

    lon0: float
    lat0: float
    dlon: float
    dlat: float
    cols: int
    rows: int


def grid_spec(collar: DataFrame, resolution_m: float = 10.0) -> GridSpec:
    """Grid that covers the extent of the located holes."""
    e = collar.agg(
        F.min("lon").alias("lon0"), F.max("lon").alias("lon1"),
        F.min("lat").alias("lat0"), F.max("lat").alias("lat1"),
    ).first()
    if e["lon0"] is None:
        raise ValueError("no located hole: a grid needs an extent")
    dlat = resolution_m / fv.METRES_PER_DEGREE
    middle = math.radians((e["lat0"] + e["lat1"]) / 2)
    dlon = resolution_m / (fv.METRES_PER_DEGREE * math.cos(middle))
    return GridSpec(
        e["lon0"], e["lat0"], dlon, dlat,
        cols=math.ceil((e["lon1"] + dlon - e["lon0"]) / dlon),
        rows=math.ceil((e["lat1"] + dlat - e["lat0"]) / dlat),
    )


def grid_points(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """Every grid point from one numeric range: no join, any number of tasks."""
    cell = spark.range(spec.rows * spec.cols).withColumnRenamed("id", "cell_id")
    return cell.select(
        "cell_id",
        F.expr(f"cell_id div {spec.cols}").alias("grow"),
        F.expr(f"cell_id % {spec.cols}").alias("gcol"),
    ).withColumns({
        "lon": F.lit(spec.lon0) + F.col("gcol") * F.lit(spec.dlon),
        "lat": F.lit(spec.lat0) + F.col("grow") * F.lit(spec.dlat),
    })


def resampled(
    spark: SparkSession, surface: DataFrame, spec: GridSpec, value: str, size: int = 300,
    fill: float = 0.0,
) -> DataFrame:
    """Bilinear ``size`` x ``size`` resample of a gridded value, limited to 0..1.

    Each output point equi-joins its four grid nodes; points whose nodes are
    missing take ``fill``.
    """
    step_x, step_y = (spec.cols - 1) / (size - 1), (spec.rows - 1) / (size - 1)
    out = spark.range(size * size).select(
        (F.col("id") % size).alias("ox"), F.expr(f"id div {size}").alias("oy")
    ).withColumns({
        "gx": F.col("ox") * F.lit(step_x), "gy": F.col("oy") * F.lit(step_y),
    }).withColumns({
        "c0": F.least(F.floor("gx"), F.lit(max(spec.cols - 2, 0))),
        "r0": F.least(F.floor("gy"), F.lit(max(spec.rows - 2, 0))),
    })
    fx, fy = F.col("gx") - F.col("c0"), F.col("gy") - F.col("r0")
    one = F.lit(1.0)
    corners = F.array(*[
        F.struct((F.col("r0") + dr).alias("grow"), (F.col("c0") + dc).alias("gcol"),
                 w.alias("w"))
        for dr, dc, w in (
            (0, 0, (one - fx) * (one - fy)), (0, 1, fx * (one - fy)),
            (1, 0, (one - fx) * fy), (1, 1, fx * fy),
        )
    ])
    nodes = out.select("ox", "oy", F.explode(corners).alias("n")).select("ox", "oy", "n.*")
    joined = nodes.join(surface.select("grow", "gcol", value), ["grow", "gcol"], "left")
    missing = F.count_if((F.col("w") > 0) & F.col(value).isNull()) > 0
    smooth = F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col("w"))
    return joined.groupBy("ox", "oy").agg(
        F.least(F.greatest(F.when(missing, F.lit(fill)).otherwise(smooth), F.lit(0.0)),
                F.lit(1.0)).alias(value)
    )


def band(value: Column) -> Column:
    """Number of surface levels at or below the value."""
    number = F.lit(0)
    for level in fv.SURFACE_LEVELS:
        number = number + F.when(value >= level, 1).otherwise(0)
    return number


def band_areas(surface: DataFrame, value: str, resolution_m: float) -> DataFrame:
    """Cells and ground area per contour band."""
    return surface.groupBy(band(F.col(value)).alias("band")).agg(
        F.count(F.lit(1)).alias("cells"),
        (F.count(F.lit(1)) * F.lit(resolution_m * resolution_m)).alias("area_m2"),
    )


def map_cells(points: DataFrame, value: str, zooms: list[int]) -> DataFrame:
    """Mean score and count per web-map cell and zoom level."""
    valid = points.filter(located())
    yy = F.radians("lat")
    north = (F.lit(1.0) - F.log(F.tan(yy) + F.lit(1.0) / F.cos(yy)) / F.lit(math.pi)) / 2
    east = (F.col("lon") + 180.0) / 360.0
    scaled = valid.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    tiles = F.pow(F.lit(2.0), F.col("zoom"))
    return scaled.groupBy(
        "zoom", F.floor(east * tiles).alias("tile_x"), F.floor(north * tiles).alias("tile_y")
    ).agg(F.count(F.lit(1)).alias("points"), (F.avg(value) / 100.0).alias("heat"))


def located(lat: str = "lat", lon: str = "lon") -> Column:
    """Coordinates present, finite and on the globe."""
    la, lo = F.col(lat), F.col(lon)
    return (
        la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo)
        & (F.abs(la) < 90) & (F.abs(lo) <= 360)
    )
