"""Raster sampling and focal statistics over pixel and tile tables.

A raster is described by a ``Raster`` (metadata, one entry per file) and stored
as rows (raster_id, prow, pcol, val) or as tiles of a fixed number of pixels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.exact import exact_quantiles
from lodeworks.session import stage_table

TILE = 32
# Pixels of a side of a tile with a rim.
RIM_TILE = 16
# At most this many tiles with a rim (about 5 kB each) are broadcast.
BROADCAST_TILES = 2000
SATURATED = 255.0
SATURATED_SHARE = 0.9
# Row or column number that stands for everything farther out.
FARTHEST = float(2**31 - 8)


@dataclass(frozen=True)
class Raster:
    raster_id: str
    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None = None
    rows: int | None = None
    cols: int | None = None


def _positions(points: DataFrame, rasters: list[Raster]) -> DataFrame:
    """One row per point and raster with the pixel row and column below it.

    Points without finite coordinates have no place; one far outside a raster gets
    the outermost number there is, which no pixel has.
    """
    def number(value: Column, start: float, step: float) -> Column:
        at = (value - F.lit(start)) / F.lit(step)
        return F.floor(F.greatest(F.least(at, F.lit(FARTHEST)), F.lit(-FARTHEST))).cast("int")

    def place(r: Raster) -> Column:
        return F.struct(
            F.lit(r.raster_id).alias("raster_id"),
            number(F.col("y"), r.y0, r.dy).alias("prow"),
            number(F.col("x"), r.x0, r.dx).alias("pcol"),
        )

    finite = [F.abs(F.col(c)) < float("inf") for c in ("x", "y")]  # NaN is above all numbers
    return (
        points.filter(finite[0] & finite[1])
        .select("*", F.explode(F.array(*[place(r) for r in rasters])).alias("_at"))
        .select(*points.columns, "_at.*")
    )


def masked(value: Column, raster_id: Column, rasters: list[Raster]) -> Column:
    """Pixel value with nodata and non-finite values as NULL."""
    is_nodata = F.lit(False)
    for r in rasters:
        if r.nodata is not None:
            is_nodata = is_nodata | ((raster_id == r.raster_id) & (value == F.lit(r.nodata)))
    usable = ~is_nodata & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(usable, value)


def tiles_from_pixels(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """Pixel rows to tiles: (raster_id, trow, tcol, map of position to value).

    A tile holds at most ``size`` * ``size`` pixels, so the group is bounded.
    """
    return pixels.groupBy(
        "raster_id",
        F.expr(f"floor(prow / {size})").cast("int").alias("trow"),
        F.expr(f"floor(pcol / {size})").cast("int").alias("tcol"),
    ).agg(F.map_from_entries(F.collect_list(F.struct(
        F.pmod("prow", F.lit(size)) * F.lit(size) + F.pmod("pcol", F.lit(size)), "val"
    ))).alias("cells"))


def sample_pixels(points: DataFrame, pixels: DataFrame, rasters: list[Raster]) -> DataFrame:
    """Value below each point per raster, long form; NULL outside or nodata."""
    at = _positions(points, rasters)
    joined = at.join(pixels, ["raster_id", "prow", "pcol"], "left")
    return joined.withColumn("val", masked(F.col("val"), F.col("raster_id"), rasters))


def sample_tiles(
    points: DataFrame, tiles: DataFrame, rasters: list[Raster], size: int = TILE
) -> DataFrame:
    """As ``sample_pixels`` over tiles: one join key per tile, not per pixel."""
    at = _positions(points, rasters).withColumns({
        "trow": F.expr(f"floor(prow / {size})").cast("int"),
        "tcol": F.expr(f"floor(pcol / {size})").cast("int"),
    })
    position = F.pmod("prow", F.lit(size)) * F.lit(size) + F.pmod("pcol", F.lit(size))
    joined = at.join(tiles, ["raster_id", "trow", "tcol"], "left")
    value = F.try_element_at("cells", position)
    return joined.select(
        *points.columns, "raster_id", "prow", "pcol",
        masked(value, F.col("raster_id"), rasters).alias("val"),
    )


def saturated_rasters(samples: DataFrame) -> list[str]:
    """Rasters whose samples are almost all 255, a fill value in byte images."""
    share = F.avg((F.coalesce(F.col("val"), F.lit(0.0)) == SATURATED).cast("double"))
    rows = samples.groupBy("raster_id").agg(share.alias("share"))
    return [r["raster_id"] for r in rows.filter(F.col("share") > SATURATED_SHARE).collect()]


def widened(samples: DataFrame, key: str, rasters: list[Raster], prefix: str = "") -> DataFrame:
    """Long samples to one column per raster."""
    ids = [r.raster_id for r in rasters]
    wide = samples.groupBy(key).pivot("raster_id", ids).agg(F.max("val"))
    return wide.select(key, *[F.col(f"`{i}`").alias(f"{prefix}{i}") for i in ids])


def raster_features(
    points: DataFrame, samples: DataFrame, key: str, rasters: list[Raster], prefix: str = ""
) -> DataFrame:
    """Sampled values as columns: saturated bands dropped, gaps at the median."""
    bad = saturated_rasters(samples)
    clean = samples
    if bad:
        keep = ~(F.col("raster_id").isin(bad) & (F.col("val") == SATURATED))
        clean = samples.withColumn("val", F.when(keep, F.col("val")))
    wide = points.select(key).join(widened(clean, key, rasters, prefix), key, "left")
    names = [f"{prefix}{r.raster_id}" for r in rasters]
    middle = exact_quantiles(wide, names, [0.5])
    fills = {n: middle[n][0] if middle[n][0] is not None else 0.0 for n in names}
    return wide.fillna(fills)


def rim_tiles(pixels: DataFrame, size: int = RIM_TILE) -> DataFrame:
    """Tiles that also hold the pixels just outside them: (raster_id, trow, tcol, cells).

    A pixel at the edge of a tile goes to the tiles beside it too, so a 3 x 3 window of any
    pixel is found in one tile. A tile holds at most (size + 2)^2 pixels.
    """
    def tiles(c: str) -> Column:
        return F.array_distinct(F.array(*[
            F.floor((F.col(c) + F.lit(d)) / F.lit(size)).cast("int") for d in (-1, 0, 1)]))

    placed = pixels.select("raster_id", "prow", "pcol", "val", F.explode(tiles("prow")).alias("trow")).select(
        "*", F.explode(tiles("pcol")).alias("tcol"))
    at = ((F.col("prow") - F.col("trow") * size + 1) * (size + 2)
          + F.col("pcol") - F.col("tcol") * size + 1)
    return placed.groupBy("raster_id", "trow", "tcol").agg(
        F.map_from_entries(F.collect_list(F.struct(at, "val"))).alias("cells"))


def rim_position(prow: Column, pcol: Column, down: int, right: int, size: int = RIM_TILE) -> Column:
    """Place in its tile of the pixel that many rows and columns from a pixel."""
    return ((F.pmod(prow, F.lit(size)) + (1 + down)) * (size + 2)
            + F.pmod(pcol, F.lit(size)) + (1 + right))


def usable_value(value: Column, nodata: Column) -> Column:
    """A pixel value, or NULL where it is nodata or not finite."""
    bad = F.coalesce(value == nodata, F.lit(False)) | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def with_rim_tiles(rows: DataFrame, tiles: DataFrame, size: int = RIM_TILE) -> DataFrame:
    """Rows (raster_id, prow, pcol, ...) with ``cells`` of their tile: an array by ``rim_position``.

    NULL without a tile. The size of grouped pixels cannot be foreseen from that of their files,
    so the tiles that rows lie on are counted first: only those are joined, and they are
    broadcast when they are few.
    """
    keys = ["raster_id", "trow", "tcol"]
    # small files of points make few tasks, and a window costs far more than to move its point
    placed = stage_table(rows.hint("rebalance").withColumns({
        c: F.floor(F.col(p) / F.lit(size)).cast("int") for c, p in (("trow", "prow"), ("tcol", "pcol"))}), "placed")
    wanted = stage_table(placed.select(*keys).distinct(), "wanted-tiles")
    few = wanted.count() <= BROADCAST_TILES
    sent = F.broadcast if few else (lambda df: df.hint("merge"))
    # a map is searched in order, an array is not
    cells = F.transform(
        F.sequence(F.lit(0), F.lit((size + 2) ** 2 - 1)), lambda i: F.try_element_at("cells", i))
    found = tiles.join(sent(wanted), keys, "left_semi").select(*keys, cells.alias("cells"))
    return placed.join(sent(found), keys, "left")


def window_statistics(nodata: Column, size: int = RIM_TILE) -> Column:
    """mean, std (of the population) and max of the 3 x 3 pixels around (prow, pcol) of a tile;
    0 without any valid pixel."""
    values = F.filter(F.array(*[
        usable_value(F.get("cells", rim_position(F.col("prow"), F.col("pcol"), r, c, size)), nodata)
        for r in (-1, 0, 1) for c in (-1, 0, 1)]), lambda v: v.isNotNull())

    def mean(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)

    def of(v: Column) -> Column:
        middle = mean(v)
        spread = F.sqrt(mean(F.transform(v, lambda x: (x - middle) * (x - middle))))
        return F.when(F.size(v) > 0, F.struct(
            middle.alias("mean"), spread.alias("std"), F.array_max(v).alias("max")
        )).otherwise(F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("std"), F.lit(0.0).alias("max")))

    # a one-element array gives the window a name inside the expression
    return F.transform(F.array(values), of)[0]


def focal_statistics(
    points: DataFrame, pixels: DataFrame, rasters: list[Raster], size: int = RIM_TILE,
) -> DataFrame:
    """Mean, population std and max of the 3 x 3 pixels around each point.

    Pixels are shuffled once, into tiles with a rim, and each point needs one join with its
    tile. Windows are cut at the raster edge; a window without any valid pixel gives 0.
    """
    joined = with_rim_tiles(_positions(points, rasters), rim_tiles(pixels, size), size)
    nodata = F.lit(None).cast("double")
    for r in rasters:
        if r.nodata is not None:
            nodata = F.when(F.col("raster_id") == r.raster_id, F.lit(r.nodata)).otherwise(nodata)
    return joined.select(
        *points.columns, "raster_id", "prow", "pcol", window_statistics(nodata, size).alias("_s"),
    ).select(*points.columns, "raster_id", "prow", "pcol", "_s.*")


def outside_bounds(points: DataFrame, raster: Raster) -> DataFrame:
    """Number of located points outside a raster of known size; one row."""
    at = _positions(points, [raster])
    inside = F.col("prow").between(0, raster.rows - 1) & F.col("pcol").between(
        0, raster.cols - 1)
    return at.groupBy("raster_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(~inside).alias("outside")
    )
