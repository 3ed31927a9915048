"""From depth intervals and attribute rows to one row per hole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks import fixedvalues as fv
from lodeworks.functions.geochem import interval_columns
from lodeworks.functions.naming import oxide_stem
from lodeworks.functions.numeric import nan_to_null, to_number


def add_interval_totals(assay: DataFrame) -> DataFrame:
    """Add total, light and heavy sums and the grade ratios to every interval."""
    return assay.withColumns(interval_columns(assay.columns))


def hole_aggregates(
    assay: DataFrame, key: str = "hole_id", ratios_by_mean_only: bool = False,
    oxides: list[str] | None = None,
) -> DataFrame:
    """Max and mean of every grade, total and ratio per hole, with the depth range.

    One hash aggregation with map-side partials, so a hole with very many
    intervals reaches the shuffle already reduced.
    """
    ratios = {name for name, *_ in fv.GRADE_RATIOS}
    grades = oxides if oxides is not None else [f"{o}_ppm" for o in fv.RARE_EARTH_OXIDES]
    wanted = [*grades, "treo", "lree", "hree", *[name for name, *_ in fv.GRADE_RATIOS]]
    measures: list[Column] = []
    for name in wanted:
        if name not in assay.columns:
            continue
        if not (ratios_by_mean_only and name in ratios):
            measures.append(F.max(name).alias(f"{name}_max"))
        measures.append(F.avg(name).alias(f"{name}_mean"))
    if "fromdepth" in assay.columns:
        measures.append(F.min("fromdepth").alias("fromdepth_min"))
    if "todepth" in assay.columns:
        measures.append(F.max("todepth").alias("todepth_max"))
    return assay.filter(F.col(key).isNotNull()).groupBy(key).agg(*measures)


def attribute_names(long_rows: DataFrame, limit: int = 10_000) -> list[str]:
    """Distinct attribute names; refused beyond ``limit`` pivot columns."""
    names = [
        r[0] for r in long_rows.select("attributecolumn").filter("attributecolumn IS NOT NULL")
        .distinct().limit(limit + 1).collect()
    ]
    if len(names) > limit:
        raise ValueError(f"more than {limit} attribute names: not a pivotable column")
    return sorted(names)


def pivot_attributes(
    long_rows: DataFrame, attributes: list[str], suffix: str, key: str = "hole_id"
) -> DataFrame:
    """Attribute rows to columns: the largest number per hole and attribute.

    Names that agree after trimming and lower-casing feed one column.
    """
    columns = sorted({a.lower().strip() for a in attributes})
    rows = long_rows.select(
        key,
        F.lower(F.trim("attributecolumn")).alias("_name"),
        to_number(F.col("attributevalue")).alias("_value"),
    )
    wide = (
        rows.filter(F.col(key).isNotNull()).groupBy(key).pivot("_name", columns)
        .agg(F.max("_value"))
    )
    return wide.select(key, *[F.col(f"`{c}`").alias(f"{c}{suffix}") for c in columns])


def alteration_counts(
    texts: DataFrame, words: list[str] = fv.ALTERATION_WORDS, key: str = "hole_id"
) -> DataFrame:
    """Rows per hole whose text mentions each keyword."""
    text = F.lower("attributevalue")
    return texts.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.count_if(text.contains(w)).alias(f"is_{w}") for w in words]
    )


def alteration_flags(
    texts: DataFrame, words: list[str] = fv.ALTERATION_WORDS[:-1], key: str = "hole_id"
) -> DataFrame:
    """1 where any text of the hole mentions the keyword, else 0."""
    text = F.coalesce(F.lower("attributevalue"), F.lit(""))
    return texts.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.max(text.contains(w).cast("int")).alias(f"alt_{w}") for w in words]
    )


def known_holes(rows: DataFrame, collar: DataFrame, key: str = "hole_id") -> DataFrame:
    """Rows whose hole is in the collar table."""
    return rows.join(collar.select(key), key, "left_semi")


def hole_master(
    collar: DataFrame, aggregates: DataFrame, extra: DataFrame | None = None,
    alteration: DataFrame | None = None, key: str = "hole_id",
) -> DataFrame:
    """Collar with assay aggregates, extra geochemistry and alteration counts.

    Every right side has one row per hole, so the collar row count is kept.
    """
    master = collar.join(aggregates, key, "left")
    if extra is not None:
        master = master.join(extra, key, "left")
    if alteration is not None:
        filled = [c for c in alteration.columns if c != key]
        master = master.join(alteration, key, "left").fillna(0, subset=filled)
    return master


def typed_collar(raw: DataFrame, id_column: str, coordinates: dict) -> DataFrame:
    """All-text collar rows to the typed collar model."""
    lon = coordinates["lon"] or coordinates["easting"]
    lat = coordinates["lat"] or coordinates["northing"]

    def number(name):
        column = to_number(F.col(name)) if name in raw.columns else F.lit(None)
        return column.cast("double")

    out = {
        "hole_id": F.trim(F.col(id_column).cast("string")),
        "lon": number(lon) if lon else F.lit(None).cast("double"),
        "lat": number(lat) if lat else F.lit(None).cast("double"),
        "elevation": number("elevation"),
        "maxdepth": number("maxdepth"),
        "dip": number("dip"),
        "azimuth": number("azimuth"),
    }
    kept = [c for c in raw.columns if c not in out and c not in (id_column, lon, lat)]
    return raw.select(*[c.alias(n) for n, c in out.items()], *[F.col(f"`{c}`") for c in kept])


def typed_assay(raw: DataFrame, key_column: str, sources: dict[str, str]) -> DataFrame:
    """All-text wide assay rows to typed intervals under canonical names.

    ``sources`` maps canonical oxide names to their source columns.
    """
    out = {"hole_id": F.trim(F.col(f"`{key_column}`").cast("string"))}
    for name in ("fromdepth", "todepth"):
        if name in raw.columns:
            out[name] = to_number(F.col(name))
    for target, source in sources.items():
        out[target] = nan_to_null(to_number(F.col(f"`{source}`")))
    for column in raw.columns:
        if oxide_stem(column) in fv.PATHFINDERS:
            out.setdefault(f"{oxide_stem(column)}_ppm", to_number(F.col(f"`{column}`")))
    return raw.select(*[c.alias(n) for n, c in out.items()])
