"""Result writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.report import geojson_feature


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(by) if by else writer).csv(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def geojson_rows(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One text row per located row: a GeoJSON point feature."""
    located = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    return located.select(geojson_feature(df.columns, lon, lat).alias("feature"))


def write_geojson_lines(df: DataFrame, path: str) -> None:
    """Features one per line, written by every task."""
    geojson_rows(df).write.mode("overwrite").text(path)


def feature_collection(df: DataFrame, k: int, order: str, tie: str) -> str:
    """The k best rows as one GeoJSON document (k bounds its size)."""
    best = df.orderBy(F.col(order).desc_nulls_last(), tie).limit(k)
    rows = [r["feature"] for r in geojson_rows(best).collect()]
    return '{"type": "FeatureCollection", "features": [' + ", ".join(rows) + "]}"
