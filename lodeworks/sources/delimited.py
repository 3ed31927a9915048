"""Delimited text: headers, encodings and heterogeneous files in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.naming import standard_names
from lodeworks.operators.files import SHOWN_COLUMNS, header_columns, rare_earth_headers

FALLBACK_ENCODING = "ISO-8859-1"


def describe_text_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Header line, encoding check and line count per file, in one pass.

    The text source hands over raw bytes, so every line can be checked for
    valid UTF-8 while files are still split over tasks.
    """
    lines = spark.read.text(paths).select(
        F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        "value", F.monotonically_increasing_id().alias("at"),
    )
    first_line = F.min_by(
        F.when(F.col("start") == 0, F.col("value")), F.when(F.col("start") == 0, F.col("at"))
    )
    return lines.groupBy("path").agg(
        first_line.alias("header"),
        F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"),
        F.count(F.lit(1)).alias("lines"),
        # an odd number of quotes: a quoted field goes on in the next line
        F.bool_or(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).alias("wraps"),
    )


def header_report(described: DataFrame) -> DataFrame:
    """Leading column names per file, and all those that mention a rare earth."""
    columns = header_columns(F.col("header"))
    return described.select(
        "path", F.slice(columns, 1, SHOWN_COLUMNS).alias("columns"),
        rare_earth_headers(columns).alias("rare_earth_columns")
    )


def read_csv(spark: SparkSession, paths: list[str], join_words: bool = True) -> DataFrame:
    """CSV files of any column order and encoding as one all-text table.

    Files are grouped by header, encoding and whether quoted fields run over
    lines; each group is one scan. Only files of the last kind are not split.
    A quote inside a quoted field is written twice.
    """
    described = describe_text_files(spark, paths)
    # One short row per distinct header: bounded by the number of files.
    groups = described.groupBy("header", "is_utf8", "wraps").agg(
        F.collect_list("path").alias("paths")
    ).orderBy("header", "is_utf8", "wraps").collect()
    tables = []
    for group in groups:
        reader = spark.read.option("header", True).option("escape", '"')
        reader = reader.option("multiLine", group["wraps"])
        if not group["is_utf8"]:
            reader = reader.option("encoding", FALLBACK_ENCODING)
        raw = reader.csv(sorted(group["paths"]))
        tables.append(raw.toDF(*standard_names(raw.columns, join_words)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
