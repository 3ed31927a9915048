"""Coordinates brought to degrees where a table holds projected metres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.geodesy import from_utm

# What longitudes in degrees never exceed.
LARGEST_LONGITUDE = 360.0
WIDEST_DEPOSIT_DEGREES = 100.0


def looks_projected(collar: DataFrame, lon: str = "lon", lat: str = "lat") -> bool:
    """Whether coordinates are metres: too large, too wide, or no latitude at all."""
    e = collar.agg(
        F.max(F.abs(F.col(lon))).alias("largest"),
        (F.max(lon) - F.min(lon)).alias("width"),
        F.count(lat).alias("latitudes"), F.count(lon).alias("longitudes"),
    ).first()
    if not e["longitudes"]:
        return False
    return (
        e["largest"] > LARGEST_LONGITUDE or e["width"] > WIDEST_DEPOSIT_DEGREES
        or not e["latitudes"]
    )


def in_degrees(
    collar: DataFrame, zone: int | None, south: bool | None,
    easting: str = "lon", northing: str = "lat",
) -> DataFrame:
    """``lon`` and ``lat`` in degrees; zone and hemisphere must be given for metres.

    Metres may stand in the lon/lat columns or in columns of their own.
    """
    if not looks_projected(collar):
        return collar
    if zone is None or south is None:
        raise ValueError("projected coordinates need a UTM zone and hemisphere")
    moved = from_utm(collar, zone, south, x=easting, y=northing, lon="_lon", lat="_lat")
    return moved.withColumns({"lon": F.col("_lon"), "lat": F.col("_lat")}).drop("_lon", "_lat")
