"""Model versions: history, latest, deltas and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_versions(registry: DataFrame, order: str = "version") -> DataFrame:
    """Newest row per deposit."""
    others = [c for c in registry.columns if c != "deposit"]
    return (
        registry.groupBy("deposit")
        .agg(F.max_by(F.struct(*others), F.col(order)).alias("_row"))
        .select("deposit", "_row.*")
    )


def version_deltas(
    registry: DataFrame, order: str = "version", bucket_rows: int = 100_000
) -> DataFrame:
    """Change of R2 and hole count against the version before.

    The history of one deposit is cut into ranges of ``order`` that are windowed
    apart; the first row of a range takes its predecessor from the last row of
    the range before, so a deposit with most of the rows is no single task.
    Numbers are ranged by ``bucket_rows``, times by day, texts by their first
    eight characters (the day of a version name).
    """
    values = ["cv_r2", "n_holes"]
    kind = dict(registry.dtypes)[order]
    if kind == "string":
        position = F.substring(order, 1, 8)
    elif kind.startswith(("timestamp", "date")):
        position = F.date_trunc("day", order)
    else:
        position = F.floor(F.col(order) / F.lit(bucket_rows))
    ranged = registry.withColumn("_range", position)
    last_rows = ranged.groupBy("deposit", "_range").agg(
        F.max_by(F.struct(*values), F.col(order)).alias("_last")
    )
    ranges = W.partitionBy("deposit").orderBy("_range")
    before = last_rows.select("deposit", "_range", F.lag("_last").over(ranges).alias("_before"))
    history = W.partitionBy("deposit", "_range").orderBy(order)
    joined = ranged.withColumns({
        f"_{v}": F.lag(v).over(history) for v in values
    }).join(before, ["deposit", "_range"])
    return joined.select(*registry.columns, *[
        (F.col(v) - F.coalesce(F.col(f"_{v}"), F.col(f"_before.{v}"))).alias(name)
        for v, name in (("cv_r2", "delta_r2"), ("n_holes", "delta_holes"))
    ])


def top_ranked(
    df: DataFrame, score: str, tie: str, k: int, group: str | None = None
) -> DataFrame:
    """The k best rows by score with their rank, over all rows or per group."""
    if group:
        order = W.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = df.orderBy(F.col(score).desc_nulls_last(), F.col(tie)).limit(k)
    # k rows are left, so numbering them in one window is bounded.
    order = W.orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return best.withColumn("rank", F.row_number().over(order))


def row_digest(columns: list[str]) -> Column:
    """Leading 15 hex digits of a row's SHA-256, as a number."""
    text = F.concat_ws("|", *[
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns
    ])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free hash of a table: row count and the sum of row digests."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(row_digest(columns)).cast("string").alias("digest"),
    )
