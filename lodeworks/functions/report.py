"""Record expressions for maps, sections and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def colour_band(score: Column, high: float, middle: float, inclusive: bool) -> Column:
    above = (lambda bound: score >= bound) if inclusive else (lambda bound: score > bound)
    return F.when(above(high), "high").when(above(middle), "middle").otherwise("low")


def grade_label(treo: Column, missing: str) -> Column:
    return F.when(treo.isNotNull(), F.concat(F.format_number(treo, 0), F.lit(" ppm"))).otherwise(
        F.lit(missing))


def percent_grade(share: Column, p95: float) -> Column:
    """Scaled label back to per cent (ppm / 10000)."""
    return share * F.lit(p95) / F.lit(10000.0)


def section_points(master: DataFrame, depth: str, treo: str) -> DataFrame:
    """Depth below the collar and marker size; large grades are log-sized."""
    grade = F.greatest(F.coalesce(F.col(treo), F.lit(0.0)), F.lit(0.0))
    largest = master.agg(F.max(grade)).first()[0] or 0.0
    return master.withColumns({
        "depth_z": F.coalesce("elevation", F.lit(0.0)) - F.coalesce(F.col(depth), F.lit(0.0)),
        "size_viz": F.log1p(grade) if largest > 1000 else grade,
    })


def geojson_feature(columns: list[str], lon: str = "lon", lat: str = "lat") -> Column:
    """One GeoJSON point feature as text; NULL properties are written as null."""
    properties = [F.col(f"`{c}`") for c in columns if c not in (lon, lat, "geometry")]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"),
            F.array(F.col(lon), F.col(lat)).alias("coordinates"),
        ).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return F.to_json(feature, {"ignoreNullFields": "false"})
