"""Attribute names in long tables mapped to canonical oxides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lodeworks.functions.naming import match_oxide


@pandas_udf(StringType())
def oxide_of(names: pd.Series) -> pd.Series:
    """Canonical oxide per name; meant for distinct names, not for every row."""
    return names.map(match_oxide, na_action="ignore")


def with_oxides(rows: DataFrame, attribute: str = "attributecolumn") -> DataFrame:
    """Add ``oxide``: names are matched once each and joined back."""
    names = rows.select(attribute).filter(F.col(attribute).isNotNull()).distinct()
    matched = names.withColumn("oxide", oxide_of(F.col(attribute)))
    return rows.join(matched, attribute, "left")
