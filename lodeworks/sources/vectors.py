"""GeoJSON polygon layers and point features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEATURE = "type string, geometry string, properties map<string,string>"
_RINGS = "struct<coordinates: array<array<array<double>>>>"
_PARTS = "struct<coordinates: array<array<array<array<double>>>>>"


def read_features(spark: SparkSession, paths: list[str], by_line: bool = False) -> DataFrame:
    """Features of GeoJSON files: feature_id, geometry as text, properties.

    Ids count the features of a file in order, from the file's place among the
    sorted paths times 2^32 on. ``by_line`` ids are a hash of path and line, so
    they do not depend on how a file is split. ``by_line`` reads one feature per line, which splits over tasks; a feature
    collection is read one file per task.
    """
    if by_line:
        return spark.read.schema(FEATURE).json(paths).select(
            F.xxhash64("_metadata.file_path", "geometry", F.to_json("properties")).alias(
                "feature_id"),
            "geometry", "properties",
        )
    whole = spark.read.option("multiLine", True).schema(f"features array<struct<{_typed()}>>")
    found = whole.json(paths).select(
        F.col("_metadata.file_path").alias("_path"), F.posexplode("features").alias("_at", "f"))
    # one row per file
    numbers = found.select("_path").distinct().select(
        "_path", (F.row_number().over(W.orderBy("_path")) - 1).cast("long").alias("_file"))
    number = F.col("_file") * F.lit(2**32) + F.col("_at")
    return found.join(numbers, "_path").select(
        number.alias("feature_id"), "f.geometry", "f.properties")


def _typed() -> str:
    return ", ".join(":".join(field.split(" ", 1)) for field in FEATURE.split(", "))


def read_polygons(
    spark: SparkSession, paths: list[str], attributes: list[str], by_line: bool = False
) -> DataFrame:
    """Polygon layer: poly_id, rings and the named attributes as text.

    The parts of a multi-polygon share its id.
    """
    features = read_features(spark, paths, by_line)
    kind = F.get_json_object("geometry", "$.type")
    single = F.array(F.from_json("geometry", _RINGS)["coordinates"])
    parts = F.when(kind == "Polygon", single).when(
        kind == "MultiPolygon", F.from_json("geometry", _PARTS)["coordinates"]
    )
    rings = F.transform("part", lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return (
        features.select("feature_id", "properties", F.explode(parts).alias("part"))
        .select(
            F.col("feature_id").alias("poly_id"), rings.alias("rings"),
            *[F.col("properties")[a].alias(a) for a in attributes],
        )
    )
