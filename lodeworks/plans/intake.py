"""From folders of mixed files to the typed inputs of a run."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions.naming import (
    contains_any, coordinate_columns, hole_id_column, hole_key_column, oxide_sources,
)
from lodeworks.operators.files import classified, detect_deposits, files_by_role
from lodeworks.operators.holes import (
    attribute_names, pivot_attributes, typed_assay, typed_collar,
)
from lodeworks.operators.placed import Placement, catalogue, placements
from lodeworks.operators.places import LARGEST_LONGITUDE, in_degrees
from lodeworks.operators.polygons import layer_attributes
from lodeworks.operators.raster import Raster
from lodeworks.plans.prospect import Inputs
from lodeworks.sources.archives import ARCHIVE_PATTERN, expand_archives, member_table
from lodeworks.sources.delimited import describe_text_files, read_csv
from lodeworks.sources.grids import read_asc
from lodeworks.sources.listing import list_files
from lodeworks.sources.vectors import read_features, read_polygons
from lodeworks.session import stage_table

TABLE_PATTERN = r"(?i)\.(csv|txt)$"
# Name words that make a geochemistry file part of the hole tables.
HOLE_TABLE_WORDS = ["dh_", "drillhole", "collar", "assay", "alter", "lith", "pivot"]
MEMBER_MARK = "!/"


@dataclass
class Intake:
    """Classified files and the tables read from them."""

    deposit: str
    files: DataFrame
    inputs: Inputs | None
    polygon_files: list[str] = field(default_factory=list)
    #: archive, member, problem: what could not be read
    problems: DataFrame | None = None


def listed_with_headers(
    spark: SparkSession, roots: list[str]
) -> tuple[DataFrame, DataFrame | None]:
    """Listing with header lines, archive members included, and the members."""
    found = list_files(spark, *roots).withColumn("header", F.lit(None).cast("string"))
    texts = [r["path"] for r in found.filter(F.col("path").rlike(TABLE_PATTERN))
             .select("path").collect()]
    if texts:
        heads = describe_text_files(spark, texts).select("path", F.col("header").alias("_h"))
        found = found.join(heads, "path", "left").withColumn("header", F.col("_h")).drop("_h")
    members = None
    if not found.filter(F.col("path").rlike(ARCHIVE_PATTERN)).isEmpty():
        members = stage_table(expand_archives(spark, roots), "members").withColumn(
            "path", F.concat("archive", F.lit(MEMBER_MARK), "member"))
        inside = members.filter("content IS NOT NULL").select(
            "path", F.length("content").cast("long").alias("length"),
            F.lit(None).cast("timestamp").alias("mtime"),
            F.when(F.col("path").rlike(TABLE_PATTERN), F.regexp_replace(
                F.substring_index(F.decode("content", "UTF-8"), "\n", 1), r"\r", "")
            ).alias("header"))
        found = found.select("path", "length", "mtime", "header").unionByName(inside)
    return found, members


def _read(spark, path: str, members: DataFrame | None) -> DataFrame:
    if MEMBER_MARK in path:
        return member_table(members.filter(F.col("path") == path))
    return read_csv(spark, [path])


def _union(tables: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None


def _collars(tables: list[DataFrame]) -> DataFrame:
    """All collar tables; of a hole in several files, the row of the last file counts."""
    if len(tables) == 1:
        return tables[0]
    rows = _union([t.withColumn("_file", F.lit(i)) for i, t in enumerate(tables)])
    # rows of one file stay as they are
    return rows.withColumn("_last", F.max("_file").over(W.partitionBy("hole_id"))).filter(
        F.col("hole_id").isNull() | (F.col("_file") == F.col("_last"))).drop("_file", "_last")


def _polygons(spark, paths: list[str]) -> tuple[DataFrame, list[str]] | None:
    """Polygons of all layers with the attributes worth joining."""
    features = read_features(spark, paths)
    # property names, a handful per file
    names = sorted(r[0] for r in features.select(
        F.explode(F.map_keys("properties"))).distinct().collect())
    attributes = layer_attributes(names)
    if not attributes:
        return None
    return stage_table(read_polygons(spark, paths, attributes), "polygons"), attributes


def _placements(rasters: list[Raster], zone: int | None, south: bool | None) -> list[Placement]:
    """Grids whose corners can't be degrees are in metres of the given zone."""
    out = []
    for r in rasters:
        ends = [r.x0, r.x0 + r.cols * r.dx, r.y0, r.y0 + r.rows * r.dy]
        metres = max(map(abs, ends[:2])) > LARGEST_LONGITUDE or max(map(abs, ends[2:])) > 90.0
        if metres and (zone is None or south is None):
            raise ValueError(f"{r.raster_id} is projected and needs a UTM zone and hemisphere")
        out.append(Placement.of(r, zone, south) if metres else Placement.of(r))
    return out


def _assay(raw: DataFrame) -> DataFrame:
    """Wide intervals; an attribute table is turned to one row per hole first."""
    key = hole_key_column(raw.columns)
    if {"attributecolumn", "attributevalue"} <= set(raw.columns):
        long_rows = raw.withColumn("hole_id", F.trim(F.col(key)))
        names = attribute_names(long_rows)
        raw = pivot_attributes(long_rows, names, "_ppm")
        key = "hole_id"
    return typed_assay(raw, key, oxide_sources(raw.columns))


def _attributes(raw: DataFrame | None) -> DataFrame | None:
    if raw is None or "attributevalue" not in raw.columns:
        return None
    key = hole_key_column(raw.columns)
    kept = [c for c in ("attributecolumn", "attributevalue") if c in raw.columns]
    return raw.select(F.trim(F.col(key)).alias("hole_id"), *kept)


def read_folder(
    spark: SparkSession, *roots: str, deposit: str | None = None, zone: int | None = None,
    south: bool | None = None,
) -> Intake:
    """Classify everything below ``roots`` and read the tables of one deposit.

    All files of a role are read. ``zone`` and ``south`` place coordinates and grids in metres.
    Archive members that could not be read are in ``problems``.
    """
    found, members = listed_with_headers(spark, list(roots))
    problems = None if members is None else members.filter("problem IS NOT NULL").select(
        "archive", "member", "problem")
    files = stage_table(classified(found), "classified")
    if deposit is None:
        named = detect_deposits(files.withColumn("all", F.lit(1)), "all").first()
        deposit = named["deposit"]
    is_table = F.col("path").rlike(TABLE_PATTERN) & (
        (F.col("layer") == "drillhole")
        | ((F.col("layer") == "geochemical") & contains_any(F.col("stem"), HOLE_TABLE_WORDS)))
    found_roles = files_by_role(
        files.filter(is_table).select(
            "path", F.col("path").alias("ordinal"), F.lit(deposit).alias("deposit")),
        "deposit").orderBy("ordinal").collect()
    roles: dict[str, list[str]] = {}
    for r in found_roles:
        roles.setdefault(r["role"], []).append(r["path"])
    by_ext = files.filter(F.col("ext").isin(".asc", ".geojson")).select("path", "ext").collect()
    outside = [(r["path"], r["ext"]) for r in by_ext if MEMBER_MARK not in r["path"]]
    layers = sorted(p for p, e in outside if e == ".geojson")
    if "collar" not in roles:
        return Intake(deposit, files, None, layers, problems)

    def tables(role: str) -> list[DataFrame]:
        return [_read(spark, path, members) for path in roles.get(role, [])]

    typed = [typed_collar(raw, hole_id_column(raw.columns), coordinate_columns(raw.columns))
             for raw in tables("collar")]
    collar = _collars([in_degrees(stage_table(t, "collar"), zone, south) for t in typed])
    collar = collar.withColumn("deposit", F.lit(deposit))
    inputs = Inputs(collar.select(
        "hole_id", "deposit", "lon", "lat", "elevation", "maxdepth", "dip", "azimuth"))
    inputs.assay = _union([_assay(raw) for raw in tables("assay")])
    inputs.alteration = _union([t for raw in tables("alteration") if (t := _attributes(raw)) is not None])
    extra = _union([t for raw in tables("geochem") if (t := _attributes(raw)) is not None])
    if extra is not None and "attributecolumn" in extra.columns:
        inputs.extra, inputs.extra_attributes = extra, attribute_names(extra)
    grids = sorted(p for p, e in outside if e == ".asc")
    if grids:
        pixels, inputs.rasters = read_asc(spark, grids)
        inputs.pixels = stage_table(pixels, "pixels")
        inputs.catalogue = stage_table(
            catalogue(placements(spark, _placements(inputs.rasters, zone, south))), "catalogue")
    if layers and (found := _polygons(spark, layers)) is not None:
        inputs.layer, inputs.layer_attributes = found
    return Intake(deposit, files, inputs, layers, problems)
