"""Rasters of any placement: rotated, sheared, in degrees or in a UTM zone of their own.

A catalogue is a table with one row per raster, so its size is not limited by a plan: points
meet rasters by an equi-join on cells of the rasters' bounds, and only pairs that meet are
projected and looked up in tiles.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.geodesy import from_utm, to_utm
from lodeworks.operators.raster import (
    RIM_TILE, Raster, rim_position, usable_value, window_statistics, with_rim_tiles,
)

#: A catalogue of at most this many filed cells (about 150 bytes each) is broadcast.
BROADCAST_CELLS = 100_000
#: Points per edge of a raster whose extent in degrees is taken, and what is added around it.
EDGE_POINTS, MARGIN = 16, 1 / 64


@dataclass(frozen=True)
class Placement:
    """x = x0 + col * xc + row * xr and y = y0 + col * yc + row * yr, in metres of ``zone``
    on the given hemisphere, or in degrees where ``zone`` is None."""

    raster_id: str
    x0: float
    y0: float
    xc: float
    xr: float
    yc: float
    yr: float
    rows: int
    cols: int
    nodata: float | None = None
    zone: int | None = None
    south: bool | None = None

    @classmethod
    def of(cls, raster: Raster, zone: int | None = None, south: bool | None = None) -> Placement:
        if raster.rows is None or raster.cols is None:
            raise ValueError("a placed raster needs its numbers of rows and columns")
        return cls(raster.raster_id, raster.x0, raster.y0, raster.dx, 0.0, 0.0, raster.dy,
                   raster.rows, raster.cols, raster.nodata, zone, south)


PLACEMENT = (
    "raster_id string, x0 double, y0 double, xc double, xr double, yc double, yr double, "
    "rows int, cols int, nodata double, zone int, south boolean")


def placements(spark: SparkSession, rasters: list[Placement]) -> DataFrame:
    """Placements as a table; larger lists come as a table of these columns right away."""
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rasters], PLACEMENT)


def catalogue(table: DataFrame) -> DataFrame:
    """Placements with their inverse and their bounds in degrees.

    Bounds of projected rasters are taken along their edges, with a margin; whether a point
    lies on a pixel is decided by the inverse alone. Rasters without pixels are dropped.
    """
    det = F.col("xc") * F.col("yr") - F.col("xr") * F.col("yc")
    inverse = table.filter((F.col("rows") > 0) & (F.col("cols") > 0)).withColumn("det", det).withColumns({
        "cx": F.col("yr") / F.col("det"), "cy": -F.col("xr") / F.col("det"),
        "rx": -F.col("yc") / F.col("det"), "ry": F.col("xc") / F.col("det"),
    }).drop("det")
    steps = [i / EDGE_POINTS for i in range(EDGE_POINTS + 1)]
    border = sorted({p for t in steps for p in ((t, 0.0), (t, 1.0), (0.0, t), (1.0, t))})
    edge = inverse.select(
        "raster_id", "x0", "y0", "xc", "xr", "yc", "yr", "rows", "cols", "zone", "south",
        F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in border])).alias("at"),
    ).withColumns({
        "x": F.col("x0") + F.col("at.u") * F.col("cols") * F.col("xc") + F.col("at.v") * F.col("rows") * F.col("xr"),
        "y": F.col("y0") + F.col("at.u") * F.col("cols") * F.col("yc") + F.col("at.v") * F.col("rows") * F.col("yr"),
    })
    zoned = from_utm(edge, F.col("zone"), F.coalesce("south", F.lit(False)))
    degrees = zoned.withColumns({
        c: F.when(F.col("zone").isNull(), F.col(flat)).otherwise(F.col(c))
        for c, flat in (("lon", "x"), ("lat", "y"))})
    extent = degrees.groupBy("raster_id").agg(
        *[f(c).alias(f"{c}{i}") for c in ("lon", "lat") for i, f in enumerate((F.min, F.max))])
    lon = (F.col("lon1") - F.col("lon0")) * MARGIN
    lat = (F.col("lat1") - F.col("lat0")) * MARGIN
    return inverse.join(extent, "raster_id").withColumns({
        "lon0": F.col("lon0") - lon, "lon1": F.col("lon1") + lon,
        "lat0": F.col("lat0") - lat, "lat1": F.col("lat1") + lat,
    })


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def meetings(points: DataFrame, rasters: DataFrame, broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """Each point (columns x, y in degrees) with each raster that has a pixel below it.

    Adds raster_id, prow, pcol and nodata. Bounds are filed under at most four cells of about
    their own size and points probe one cell per size in use. A raster across the date line, or
    one that counts longitudes from 0 to 360, is filed a turn to the left and right too. Points
    without finite coordinates meet nothing.
    """
    side = F.greatest(F.col("lon1") - F.col("lon0"), F.col("lat1") - F.col("lat0"), F.lit(1e-9))
    turned = rasters.withColumn("turn", F.explode(F.array(*[F.lit(t) for t in (-360.0, 0.0, 360.0)]))).filter(
        (F.col("lon0") + F.col("turn") <= 360.0) & (F.col("lon1") + F.col("turn") >= -180.0))
    filed = turned.withColumn("level", F.ceil(F.log2(side)).cast("int")).withColumns({
        "lon0": F.col("lon0") + F.col("turn"), "lon1": F.col("lon1") + F.col("turn")})
    levels = sorted(r["level"] for r in filed.select("level").distinct().collect())
    cells = filed.withColumn("_cx", F.explode(F.sequence(
        _cell(F.col("lon0"), F.col("level")), _cell(F.col("lon1"), F.col("level"))))).withColumn(
        "_cy", F.explode(F.sequence(
            _cell(F.col("lat0"), F.col("level")), _cell(F.col("lat1"), F.col("level")))))
    if cells.limit(broadcast_cells + 1).count() <= broadcast_cells:
        cells = F.broadcast(cells)
    finite = (F.abs(F.col("x")) < float("inf")) & (F.abs(F.col("y")) < float("inf"))
    asked = points.select(F.struct(*points.columns).alias("_p")).select(
        "_p", F.col("_p.x").alias("lon"), F.col("_p.y").alias("lat")).withColumns(
        {"x": F.col("lon"), "y": F.col("lat")}).filter(finite).select("_p", "lon", "lat").withColumn(
        "level", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
    probes = asked.withColumns({
        "_cx": _cell(F.col("lon"), F.col("level")), "_cy": _cell(F.col("lat"), F.col("level"))})
    pairs = probes.join(cells, ["level", "_cx", "_cy"]).filter(
        F.col("lon").between(F.col("lon0"), F.col("lon1")) & F.col("lat").between(F.col("lat0"), F.col("lat1")))
    moved = to_utm(pairs, F.col("zone"), F.coalesce("south", F.lit(False)), x="_x", y="_y")
    easting = F.when(F.col("zone").isNull(), F.col("lon") - F.col("turn")).otherwise(F.col("_x")) - F.col("x0")
    northing = F.when(F.col("zone").isNull(), F.col("lat")).otherwise(F.col("_y")) - F.col("y0")
    at = moved.withColumns({"_e": easting, "_n": northing}).withColumns({
        "prow": F.floor(F.col("rx") * F.col("_e") + F.col("ry") * F.col("_n")).cast("int"),
        "pcol": F.floor(F.col("cx") * F.col("_e") + F.col("cy") * F.col("_n")).cast("int"),
    })
    inside = F.col("prow").between(0, F.col("rows") - 1) & F.col("pcol").between(0, F.col("cols") - 1)
    return at.filter(inside).select("_p.*", "raster_id", "prow", "pcol", "nodata")


def sample_placed(
    points: DataFrame, tiles: DataFrame, rasters: DataFrame, size: int = RIM_TILE,
) -> DataFrame:
    """Value below each point for each raster it meets; NULL for nodata and missing pixels.

    ``tiles`` are those of ``raster.rim_tiles``, ``rasters`` is a catalogue.
    """
    joined = with_rim_tiles(meetings(points, rasters), tiles, size)
    value = F.get("cells", rim_position(F.col("prow"), F.col("pcol"), 0, 0, size))
    return joined.select(
        *points.columns, "raster_id", "prow", "pcol", usable_value(value, F.col("nodata")).alias("val"))


def focal_placed(
    points: DataFrame, tiles: DataFrame, rasters: DataFrame, size: int = RIM_TILE,
) -> DataFrame:
    """Mean, population std and max of the 3 x 3 pixels around each point for each raster met."""
    joined = with_rim_tiles(meetings(points, rasters), tiles, size)
    return joined.select(
        *points.columns, "raster_id", "prow", "pcol", window_statistics(F.col("nodata"), size).alias("_s"),
    ).select(*points.columns, "raster_id", "prow", "pcol", "_s.*")
