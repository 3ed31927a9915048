"""Spectral indices over reflectance band columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is not positive or either side is missing."""
    return F.coalesce(F.when(b > 0, a / b), F.lit(0.0))


def spectral_indices(bands: dict[str, Column], prefix: str = "si_") -> dict[str, Column]:
    """Every index whose bands are present, as named columns."""

    def difference(high, low):
        return safe_ratio(high - low, high + low)

    wanted = {
        "ndvi": (("red", "nir"), lambda red, nir: difference(nir, red)),
        "iron_oxide": (("red", "blue"), safe_ratio),
        "ferric_iron": (("red", "green"), safe_ratio),
        "clay_index": (("swir1", "swir2"), safe_ratio),
        "ndwi": (("nir", "swir1"), difference),
        "alteration": (("swir1", "red"), safe_ratio),
    }
    return {
        prefix + name: index(*(bands[b] for b in needs))
        for name, (needs, index) in wanted.items()
        if all(b in bands for b in needs)
    }
