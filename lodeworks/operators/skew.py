"""Equi-joins whose left side may hold one key in a third of its rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that can be hot at once, as each holds more than this share of the rows.
HOT_KEYS = 256
#: Rows of one key that are never worth another task.
FEW_ROWS = 100_000


def salted_join(
    left: DataFrame, right: DataFrame, key: str, spread: list[str], few_rows: int = FEW_ROWS,
) -> DataFrame:
    """Inner join on ``key``; the rows of hot left keys are dealt to copies of their right rows.

    ``left`` should be staged, as its keys are counted first. A key is hot above a
    1/HOT_KEYS share of all rows, so the list of hot keys is short whatever the size.
    ``spread`` names left columns by which the rows of a key are dealt.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(few_rows, math.ceil(total / HOT_KEYS))
    hot = counts.filter(F.col("n") > limit).collect() if total > limit else []
    if not hot:
        return left.join(right, key)
    salts = F.broadcast(left.sparkSession.createDataFrame(
        [(r[key], -(-r["n"] // limit)) for r in hot],
        f"{key} {left.schema[key].dataType.simpleString()}, _salts long"))
    dealt = left.join(salts, key, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(*spread), "_salts"), F.lit(0))).drop("_salts")
    copies = right.join(salts, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
