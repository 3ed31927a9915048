"""UTM / MGA projection as Column expressions (Krueger series, third order)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 (GRS80 differs by less than 0.1 mm in these series).
FLATTENING = 1 / 298.257223563
SEMI_MAJOR = 6378137.0
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

_n = FLATTENING / (2 - FLATTENING)
RECTIFYING = SCALE * SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
CONFORMAL = 2 * math.sqrt(_n) / (1 + _n)
FORWARD = [
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16,
    13 * _n**2 / 48 - 3 * _n**3 / 5,
    61 * _n**3 / 240,
]
BACKWARD = [
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96,
    _n**2 / 48 + _n**3 / 15,
    17 * _n**3 / 480,
]
LATITUDE = [
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3,
    7 * _n**2 / 3 - 8 * _n**3 / 5,
    56 * _n**3 / 15,
]


def _meridian(zone: int | Column) -> Column:
    if isinstance(zone, Column):
        return F.lit(6.0) * zone - F.lit(183.0)
    if not 1 <= zone <= 60:
        raise ValueError(f"UTM zone must be 1..60, got {zone}")
    return F.lit(6.0 * zone - 183.0)


def _north0(south: bool | Column) -> Column:
    if isinstance(south, Column):
        return F.when(south, FALSE_NORTHING_SOUTH).otherwise(0.0)
    return F.lit(FALSE_NORTHING_SOUTH if south else 0.0)


def _series(terms, first, other, xi, eta):
    total = F.lit(0.0)
    for j, term in enumerate(terms, start=1):
        angle = F.lit(2.0 * j)
        total = total + F.lit(term) * first(angle * xi) * other(angle * eta)
    return total


def to_utm(
    df: DataFrame, zone: int | Column, south: bool | Column, lon="lon", lat="lat", x="x", y="y"
) -> DataFrame:
    """Add projected metres ``x``, ``y`` for degrees ``lon``, ``lat``; a zone may be a column."""
    meridian, north0 = _meridian(zone), _north0(south)
    sine = F.sin(F.radians(F.col(lat)))
    dlon = F.radians(F.col(lon) - meridian)
    t = F.col("_t")
    xi, eta = F.col("_xi"), F.col("_eta")
    return (
        df.withColumn(
            "_t",
            F.sinh(F.atanh(sine) - F.lit(CONFORMAL) * F.atanh(F.lit(CONFORMAL) * sine)),
        )
        .withColumns(
            {
                "_xi": F.atan2(t, F.cos(dlon)),
                "_eta": F.atanh(F.sin(dlon) / F.sqrt(F.lit(1.0) + t * t)),
            }
        )
        .withColumns(
            {
                x: F.lit(FALSE_EASTING)
                + F.lit(RECTIFYING) * (eta + _series(FORWARD, F.cos, F.sinh, xi, eta)),
                y: north0
                + F.lit(RECTIFYING) * (xi + _series(FORWARD, F.sin, F.cosh, xi, eta)),
            }
        )
        .drop("_t", "_xi", "_eta")
    )


def from_utm(
    df: DataFrame, zone: int | Column, south: bool | Column, x="x", y="y", lon="lon", lat="lat"
) -> DataFrame:
    """Add degrees ``lon``, ``lat`` for projected metres ``x``, ``y``; a zone may be a column."""
    meridian, north0 = _meridian(zone), _north0(south)
    xi, eta = F.col("_xi"), F.col("_eta")
    xi1, eta1, chi = F.col("_xi1"), F.col("_eta1"), F.col("_chi")
    latitude = chi
    for j, term in enumerate(LATITUDE, start=1):
        latitude = latitude + F.lit(term) * F.sin(F.lit(2.0 * j) * chi)
    return (
        df.withColumns(
            {
                "_xi": (F.col(y) - north0) / F.lit(RECTIFYING),
                "_eta": (F.col(x) - F.lit(FALSE_EASTING)) / F.lit(RECTIFYING),
            }
        )
        .withColumns(
            {
                "_xi1": xi - _series(BACKWARD, F.sin, F.cosh, xi, eta),
                "_eta1": eta - _series(BACKWARD, F.cos, F.sinh, xi, eta),
            }
        )
        .withColumn("_chi", F.asin(F.sin(xi1) / F.cosh(eta1)))
        .withColumns(
            {
                lat: F.degrees(latitude),
                lon: meridian + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))),
            }
        )
        .drop("_xi", "_eta", "_xi1", "_eta1", "_chi")
    )
