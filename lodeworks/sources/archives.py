"""Archive expansion: members of zip and tar files as rows."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.naming import standard_names
from lodeworks.session import stage_table

MEMBER_SCHEMA = "archive string, member string, depth int, content binary, problem string"
# A cell holds at most 2 GB; larger archives are reported, not opened.
MAX_ARCHIVE_BYTES = 2**31 - 2**20
ARCHIVE_PATTERN = r"(?i)\.(zip|tar|tgz|tar\.gz|tar\.bz2|gz)$"


# What a corrupt, encrypted or unknown archive raises.
_UNREADABLE = (
    zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, zlib.error, RuntimeError,
    NotImplementedError, ValueError,
)


def _safe(name: str) -> bool:
    return not name.startswith("/") and ".." not in name.split("/")


def _open_members(name: str, data: bytes):
    """Yield (member name, bytes) of one archive."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for item in z.infolist():
                if not item.is_dir():
                    yield item.filename, z.read(item)
    elif name.lower().endswith(".gz") and not name.lower().endswith(".tar.gz"):
        yield name.rsplit("/", 1)[-1].rsplit("!", 1)[-1][:-3], gzip.decompress(data)
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for item in t:
                if item.isfile():
                    yield item.name, t.extractfile(item).read()


def _expand(batches):
    for batch in batches:
        for archive, name, depth, content in zip(
            batch["archive"], batch["member"], batch["depth"], batch["content"]
        ):
            # one member at a time, so the task holds no more than that
            try:
                for member, data in _open_members(name, bytes(content)):
                    problem = None if _safe(member) else "unsafe member name"
                    yield _row(archive, f"{name}!{member}" if depth else member, depth + 1,
                               None if problem else data, problem)
            except _UNREADABLE as error:
                yield _row(archive, name, depth, None, str(error) or "unreadable")


def _row(*values) -> pd.DataFrame:
    return pd.DataFrame([values], columns=["archive", "member", "depth", "content", "problem"])


def expand_archives(spark: SparkSession, paths: list[str], max_depth: int = 4) -> DataFrame:
    """Members of all archives, nested ones included down to ``max_depth``.

    Unsafe or unreadable members and oversized archives come back with a
    ``problem`` and no content; the other archives are not affected.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
        .withColumn("archive", F.regexp_replace("path", "^file:/+", "/"))
        .filter(F.col("path").rlike(ARCHIVE_PATTERN))
    )
    oversized = files.filter(F.col("length") > MAX_ARCHIVE_BYTES).select(
        "archive", F.col("archive").alias("member"), F.lit(0).alias("depth"),
        F.lit(None).cast("binary").alias("content"), F.lit("archive too large").alias("problem"),
    )
    level = files.filter(F.col("length") <= MAX_ARCHIVE_BYTES).select(
        "archive", F.col("archive").alias("member"), F.lit(0).alias("depth"), "content"
    )
    done = oversized
    for _ in range(max_depth):
        members = stage_table(level.mapInPandas(_expand, MEMBER_SCHEMA), "members")
        nested = F.col("member").rlike(ARCHIVE_PATTERN) & F.col("content").isNotNull()
        done = done.unionByName(members.filter(~nested))
        level = members.filter(nested).select("archive", "member", "depth", "content")
        if level.isEmpty():
            return done
    return done.unionByName(level.withColumn("problem", F.lit("nested too deep")))


def member_table(members: DataFrame) -> DataFrame:
    """Delimited archive members of any header as one all-text table.

    Member contents are decoded as UTF-8, or as Latin-1 where that fails, and
    split to lines by the tasks that hold them.
    """
    text = F.when(
        F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")
    ).otherwise(F.decode("content", "ISO-8859-1"))
    lines = members.filter(F.col("content").isNotNull()).select(
        F.split(F.regexp_replace(text, r"\r", ""), "\n").alias("lines")
    ).select(F.col("lines")[0].alias("header"), F.explode(
        F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    rows = stage_table(lines.filter(F.trim("line") != ""), "member-lines")
    headers = sorted(r[0] for r in rows.select("header").distinct().collect())
    tables = []
    for header in headers:
        names = standard_names([c.strip().strip('"') for c in header.split(",")])
        schema = ", ".join(f"`{n}` string" for n in names)
        parsed = rows.filter(F.col("header") == header).select(
            F.from_csv("line", schema).alias("row"))
        tables.append(parsed.select("row.*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
