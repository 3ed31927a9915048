"""Per-hole aggregates kept current while intervals arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.holes import add_interval_totals


def without_repeats(
    intervals: DataFrame, arrival: str, delay: str, keys: tuple = ("hole_id", "fromdepth")
) -> DataFrame:
    """Drop intervals delivered again within ``delay`` of their first arrival.

    State is bounded by the watermark: later repeats count as new data.
    """
    return intervals.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(list(keys))


def hole_updates(intervals: DataFrame) -> DataFrame:
    """Streaming aggregate: one running row per hole."""
    return add_interval_totals(intervals).groupBy("hole_id").agg(
        F.max("treo").alias("treo_max"), F.avg("treo").alias("treo_mean"),
        F.min("fromdepth").alias("fromdepth_min"), F.max("todepth").alias("todepth_max"),
        F.count(F.lit(1)).alias("intervals"),
    )


def start(updates: DataFrame, table: str, checkpoint: str, **trigger):
    """Append every changed hole row with its batch number to ``table``.

    A batch that is run again after a failure replaces its own folder, so the
    table holds each update once.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        updates.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def current_holes(spark: SparkSession, table: str) -> DataFrame:
    """Newest row per hole."""
    rows = spark.read.parquet(table)
    values = [c for c in rows.columns if c not in ("hole_id", "batch")]
    return (
        rows.groupBy("hole_id").agg(F.max_by(F.struct(*values), "batch").alias("_row"))
        .select("hole_id", "_row.*")
    )
