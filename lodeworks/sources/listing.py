"""File listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.files import with_name_parts

LISTING_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """Recursive listing: path, length and mtime; contents are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    return found.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        "length", F.col("modificationTime").alias("mtime"),
    )


def inventory(spark: SparkSession, *roots: str) -> DataFrame:
    """Listing with name, stem, extension and folder."""
    return with_name_parts(list_files(spark, *roots))
