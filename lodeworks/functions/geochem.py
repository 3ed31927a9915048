"""Column expressions for grades, ratios, depth and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks import fixedvalues as fv
from lodeworks.functions.numeric import clip


def grade_total(grades: list[Column]) -> Column:
    """Row sum that skips NULL and is NULL only when every grade is."""
    return F.when(F.coalesce(*grades).isNotNull(), subtotal(grades))


def subtotal(grades: list[Column]) -> Column:
    """Row sum that skips NULL; 0 when every grade is NULL."""
    return reduce(lambda a, b: a + b, [F.coalesce(g, F.lit(0.0)) for g in grades])


def guarded_ratio(numerator: Column, denominator: Column, offset: float) -> Column:
    return F.try_divide(numerator, denominator + F.lit(offset))


def interval_columns(columns: list[str]) -> dict[str, Column]:
    """Totals and ratios one assay table supports, keyed by column name.

    Oxides are used where present, otherwise the element-form columns.
    """
    have = set(columns)

    def present(names):
        return [F.col(f"{n}_ppm") for n in names if f"{n}_ppm" in have]

    out: dict[str, Column] = {}
    total = present(fv.RARE_EARTH_OXIDES) or present(fv.LIGHT_ELEMENTS)
    light = present(fv.LIGHT_OXIDES) or present(fv.LIGHT_ELEMENTS)
    heavy = present(fv.HEAVY_OXIDES) or present(fv.HEAVY_ELEMENTS)
    if total:
        out["treo"] = grade_total(total)
    if light:
        out["lree"] = subtotal(light)
    if heavy:
        out["hree"] = subtotal(heavy)
    for name, top, bottom, offset in fv.GRADE_RATIOS:
        sides = [out.get(side, F.col(side)) for side in (top, bottom)]
        if all(side in out or side in have for side in (top, bottom)):
            out[name] = guarded_ratio(sides[0], sides[1], offset)
    return out


def depth_score(depth: Column, ladder: str = "hole") -> Column:
    """Step function of depth to mineralisation; unknown depth has its own score."""
    steps, beyond = fv.DEPTH_LADDERS[ladder]
    score = F.when(depth.isNull(), F.lit(fv.DEPTH_UNKNOWN))
    for bound, value in steps:
        score = score.when(depth < F.lit(float(bound)), F.lit(value))
    return score.otherwise(F.lit(beyond))


def log_grade(grade: Column) -> Column:
    """log(1 + grade) with negative grades taken as 0; NULL stays NULL."""
    return F.when(grade.isNotNull(), F.log1p(F.greatest(grade, F.lit(0.0))))


def is_log_scaled(name: str) -> bool:
    """Whether a feature of this name is log-scaled before modelling."""
    return "_ppm" in name or "ratio" in name or name in fv.LOGGED_TOTALS


def scaled_label(treo: Column, p95: float) -> Column:
    return clip(treo / F.lit(p95), 0.0, 1.0)


def label_scale(p95: float | None, labelled: int) -> float:
    """The 95th percentile, or its fallback for few labels or no grade."""
    if labelled <= 5:
        return fv.FALLBACK_P95
    return p95 if p95 and p95 > 0 else 1.0


def idw_weight(distance_degrees: Column) -> Column:
    metres = F.greatest(
        distance_degrees * F.lit(fv.METRES_PER_DEGREE), F.lit(fv.MIN_DISTANCE_M)
    )
    return F.lit(1.0) / (metres * metres)


def idw_confidence(nearest_degrees: Column) -> Column:
    metres = F.greatest(
        nearest_degrees * F.lit(fv.METRES_PER_DEGREE), F.lit(fv.MIN_DISTANCE_M)
    )
    return F.lit(1.0) / (F.lit(1.0) + metres / F.lit(100.0))


def centroid_distance(lon: Column, lat: Column, clon: float, clat: float) -> Column:
    """Equirectangular distance to a centroid in units of the deposit radius."""
    metres = F.lit(fv.METRES_PER_DEGREE)
    east = (lon - F.lit(clon)) * metres * F.cos(F.radians(F.lit(clat)))
    north = (lat - F.lit(clat)) * metres
    return F.sqrt(east * east + north * north) / F.lit(fv.CENTROID_SCALE_M)


def range_scaled(value: Column, low: float, high: float) -> Column:
    return (value - F.lit(low)) / F.lit(high - low + fv.RANGE_EPSILON)
