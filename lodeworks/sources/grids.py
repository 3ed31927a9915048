"""Text rasters (.asc, .xyz) and spectral scenes as pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions.naming import file_stem
from lodeworks.functions.numeric import to_number
from lodeworks.operators.raster import Raster

HEADER_KEYS = [
    "ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize",
    "nodata_value",
]


def numbered_values(lines: DataFrame) -> DataFrame:
    """``values`` of each line with the number in the file of the first, as ``first``.

    ``lines`` has path, start (of the split), at (order in the split) and values.
    Splits are numbered apart and shifted by the counts of the splits before, so a
    large file is not one task.
    """
    split = W.partitionBy("path", "start").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    counted = lines.withColumn("n", F.size("values").cast("long"))
    offsets = counted.groupBy("path", "start").agg(F.sum("n").alias("n")).select(
        "path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return (
        counted.withColumn("earlier", F.coalesce(F.sum("n").over(split), F.lit(0)))
        .join(offsets, ["path", "start"])
        .select("path", (F.col("earlier") + F.col("offset")).alias("first"), "values")
    )


def read_asc(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[Raster]]:
    """ASCII grids as pixel rows plus one ``Raster`` per file.

    Values are placed by their order, so rows may run over several lines. The origin
    is the corner or the centre of the lower left cell. Files of one name in several
    folders are told apart by a number, in the order of their paths.
    """
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(paths).filter(F.trim("value") != "").select(
        F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), words.alias("values"),
    )
    key = F.lower(F.col("values")[0])
    heads = lines.filter(key.isin(HEADER_KEYS)).groupBy("path").agg(*[
        F.max(F.when(key == k, to_number(F.col("values")[1]))).alias(k) for k in HEADER_KEYS
    ])
    # one row per file
    same = F.row_number().over(W.partitionBy("stem").orderBy("path"))
    named = heads.withColumn("stem", file_stem(F.col("path"))).withColumn(
        "raster_id", F.when(same == 1, F.col("stem")).otherwise(
            F.concat("stem", F.lit("~"), same.cast("string"))))
    half = F.col("cellsize") / 2
    placed = named.select(
        "path", "raster_id", "nrows", "ncols", "cellsize", "nodata_value",
        F.coalesce("xllcorner", F.col("xllcenter") - half).alias("west"),
        F.coalesce("yllcorner", F.col("yllcenter") - half).alias("south"),
    )
    rasters = [
        Raster(
            r["raster_id"], x0=r["west"], y0=r["south"] + r["nrows"] * r["cellsize"],
            dx=r["cellsize"], dy=-r["cellsize"], nodata=r["nodata_value"],
            rows=int(r["nrows"]), cols=int(r["ncols"]),
        )
        for r in placed.orderBy("path").collect()
    ]
    place = F.col("first") + F.col("offset")
    cells = (
        numbered_values(lines.filter(~key.isin(HEADER_KEYS)))
        .join(placed.select("path", "raster_id", F.col("ncols").cast("long").alias("ncols")), "path")
        .select("raster_id", "ncols", "first", F.posexplode("values").alias("offset", "text"))
        .select("raster_id", F.floor(place / F.col("ncols")).cast("int").alias("prow"),
                (place % F.col("ncols")).cast("int").alias("pcol"),
                to_number(F.col("text")).alias("val"))
    )
    return cells, rasters


def read_xyz(spark: SparkSession, paths: list[str], raster: Raster) -> DataFrame:
    """``x y value`` lines as pixel rows of a raster of known placement."""
    words = F.split(F.trim("value"), r"[\s,]+")
    points = spark.read.text(paths).select(
        to_number(words[0]).alias("x"), to_number(words[1]).alias("y"),
        to_number(words[2]).alias("val"),
    ).filter("x IS NOT NULL AND y IS NOT NULL")
    return points.select(
        F.lit(raster.raster_id).alias("raster_id"),
        F.floor((F.col("y") - F.lit(raster.y0)) / F.lit(raster.dy)).cast("int").alias("prow"),
        F.floor((F.col("x") - F.lit(raster.x0)) / F.lit(raster.dx)).cast("int").alias("pcol"),
        "val",
    )
