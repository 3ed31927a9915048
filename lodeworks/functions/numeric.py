"""Column expressions for number handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL.

    The pattern keeps out forms Spark would accept (``1d``, ``NaN``).
    """
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.when(~F.isnan(value), value)


def finite_or_zero(value: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(usable, value).otherwise(F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    limited = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), limited)


def half_even(value: Column, digits: int) -> Column:
    """Round as numpy does: scale, round half to even, scale back."""
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale


def score_100(prospectivity: Column) -> Column:
    """Prospectivity in 0..1 to a 0-100 score with one decimal."""
    return half_even(clip(prospectivity, 0.0, 1.0) * F.lit(100.0), 1)


def byte_size(size: Column) -> Column:
    """Bytes as text: one decimal and a binary unit."""
    text = F.format_string("%.1f TB", size / F.lit(1024.0**4))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        text = F.when(
            size < F.lit(1024.0 ** (power + 1)),
            F.format_string(f"%.1f {unit}", size / F.lit(1024.0**power)),
        ).otherwise(text)
    return text
