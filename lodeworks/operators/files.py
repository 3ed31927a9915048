"""Classification and roll-ups over a file listing (path, length, mtime, header).

Rule tables are turned into expressions, so classifying a listing is one narrow
pass whatever the number of files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks import fixedvalues as fv
from lodeworks.functions.naming import (
    contains_any, file_extension, file_name, file_stem, folder_name, normal_name, words_in,
)
from lodeworks.functions.numeric import half_even


def with_name_parts(listing: DataFrame) -> DataFrame:
    """Add file name, normalised stem, extension and folder."""
    path = F.col("path")
    return listing.withColumns({
        "name": file_name(path),
        "stem": normal_name(file_stem(path)),
        "ext": file_extension(path),
        "folder": folder_name(path),
    })


def lookup(key: Column, table: dict[str, list[str]], otherwise: Column) -> Column:
    """First table entry whose list holds the key."""
    hits = [F.when(key.isin(values), F.lit(name)) for name, values in table.items()]
    return F.coalesce(*hits, otherwise)


def inventory_category(ext: Column) -> Column:
    return lookup(ext, fv.INVENTORY_CATEGORIES, F.lit("other"))


def retention_class(ext: Column) -> Column:
    return (
        F.when(ext.isin(fv.DELETABLE_EXTENSIONS), "deletable")
        .when(ext.isin(fv.KEPT_EXTENSIONS), "keep")
        .otherwise("unclassed")
    )


def classified(listing: DataFrame) -> DataFrame:
    """Add layer, confidence, the score map and up to four reasons per file.

    The first word of a layer's list that occurs in the name decides its name
    points; the first layer that lists the extension gets the extension points;
    every header word counts.
    """
    named = with_name_parts(listing)
    ext = F.col("ext")
    header = F.coalesce(F.lower("header"), F.lit("")) if "header" in listing.columns else F.lit("")
    reads_header = ext.isin(fv.HEADER_EXTENSIONS)
    found = named.withColumns({
        "_ext_layer": lookup(ext, fv.EXTENSION_LAYERS, F.lit(None).cast("string")),
        **{f"_name_{layer}": F.try_element_at(words_in(F.col("stem"), words), F.lit(1))
           for layer, words in fv.NAME_WORDS.items()},
        **{f"_head_{layer}": F.when(reads_header, words_in(header, words))
           for layer, words in fv.HEADER_WORDS.items()},
    })
    is_image, scenic = ext.isin(fv.IMAGE_EXTENSIONS), F.col("_name_satellite").isNotNull()
    extra = {
        "satellite": F.when(is_image & scenic, 5).otherwise(0),
        "geophysics": F.when(is_image & ~scenic, 2).otherwise(0),
    }
    points, reasons = {}, []
    for layer in fv.LAYERS:
        score = F.when(F.col("_ext_layer") == layer, 2).otherwise(0)
        if layer in fv.NAME_WORDS:
            word = F.col(f"_name_{layer}")
            score = score + F.when(word.isin(fv.STRONG_NAME_WORDS), 10).when(
                word.isNotNull(), 3).otherwise(0)
        if layer in fv.HEADER_WORDS:
            score = score + F.coalesce(F.size(f"_head_{layer}"), F.lit(0)) * 2
        points[f"_p_{layer}"] = score + extra.get(layer, F.lit(0))
    for layer in fv.NAME_WORDS:
        word = F.col(f"_name_{layer}")
        reasons.append(F.when(word.isNotNull(), F.format_string(
            f"filename contains '%s': {layer}", word)))
    reasons.append(F.when(F.col("_ext_layer").isNotNull(), F.format_string(
        "extension '%s': %s", ext, F.col("_ext_layer"))))
    for layer in fv.HEADER_WORDS:
        words = F.col(f"_head_{layer}")
        reasons.append(F.when(F.size(words) > 0, F.format_string(
            f"columns %s: {layer}", F.array_join(F.slice(words, 1, 3), ", "))))
    scored = found.withColumns(points)
    best = F.greatest(*[F.col(p) for p in points])
    total = reduce(lambda a, b: a + b, [F.col(p) for p in points])
    # Equal scores go to the layer listed first.
    winner = F.coalesce(*[
        F.when(F.col(f"_p_{layer}") == best, F.lit(layer)) for layer in fv.LAYERS
    ])
    return scored.select(
        *named.columns, winner.alias("layer"),
        half_even(best / F.greatest(total, F.lit(1)), 2).alias("confidence"),
        F.create_map(*[
            x for layer in fv.LAYERS for x in (F.lit(layer), F.col(f"_p_{layer}"))
        ]).alias("scores"),
        F.slice(F.filter(F.array(*reasons), lambda r: r.isNotNull()), 1, 4).alias("reasons"),
    )


def layer_groups(files: DataFrame) -> DataFrame:
    """Files and bytes per layer."""
    return files.groupBy("layer").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def deposit_of_folder(folder: Column) -> Column:
    return normal_name(folder)


def detect_deposits(files: DataFrame, group: str) -> DataFrame:
    """Deposit name per upload group: known words first, else the usual folder.

    Files are first counted per folder, so the group never has to be collected.
    """
    stem = F.lower(file_stem(F.col("path")))
    folder = F.translate(F.lower(folder_name(F.col("path"))), " ", "_")
    per_folder = files.groupBy(group, folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(contains_any(stem, words)).alias(f"is_{d}")
          for d, words in fv.KNOWN_DEPOSITS.items()],
    )
    known = F.coalesce(*[
        F.when(F.max(f"is_{d}"), F.lit(d)) for d in fv.KNOWN_DEPOSITS
    ])
    usual = F.min_by("folder", F.struct(-F.col("n"), F.col("folder")))
    return per_folder.groupBy(group).agg(
        F.coalesce(known, usual, F.lit(fv.UNKNOWN_DEPOSIT)).alias("deposit")
    )


def table_roles(files: DataFrame, group: str) -> DataFrame:
    """Which file of each group is the collar, assay, alteration or geochemistry.

    ``ordinal`` gives the order of arrival. A pivoted assay beats a plain one;
    the last collar, pivot, alteration and geochemistry file counts, and the
    first plain assay. Without a collar the first three files take the roles.
    """
    stem = F.lower(file_stem(F.col("path")))
    role = (
        F.when(stem.contains("collar"), "collar")
        .when(stem.contains("pivot"), "pivot")
        .when(stem.contains("assay"), "assay")
        .when(stem.contains("alter"), "alteration")
        .when(stem.contains("geochem"), "geochem")
    )
    order = F.col("ordinal")

    def last(name):
        return F.max_by(F.when(F.col("role") == name, F.col("path")),
                        F.when(F.col("role") == name, order))

    # Spark limits each group to its first rows before the shuffle.
    first_three = (
        files.select(group, "path", "ordinal")
        .withColumn("n", F.row_number().over(W.partitionBy(group).orderBy("ordinal")))
        .filter("n <= 3").groupBy(group).pivot("n", [1, 2, 3]).agg(F.first("path"))
    )
    named = files.withColumn("role", role).groupBy(group).agg(
        last("collar").alias("collar"), last("pivot").alias("pivot"),
        F.min_by(F.when(F.col("role") == "assay", F.col("path")),
                 F.when(F.col("role") == "assay", order)).alias("plain"),
        last("alteration").alias("alteration"), last("geochem").alias("geochem"),
    )
    has_collar = F.col("collar").isNotNull()
    assay = F.coalesce("pivot", "plain")
    return named.join(first_three, group).select(
        group,
        F.coalesce("collar", "1").alias("collar"),
        F.when(has_collar, assay).otherwise(F.coalesce("2", assay)).alias("assay"),
        F.when(has_collar, F.col("alteration"))
        .otherwise(F.coalesce("3", "alteration")).alias("alteration"),
        "geochem",
    )


def files_by_role(files: DataFrame, group: str) -> DataFrame:
    """Every file of each role of a group: group, role, path, ordinal.

    Roles are those of ``table_roles``. All pivoted assays count, or all plain ones where
    there is no pivoted one. In a group without a collar the first three files are the collar,
    the assay and the alteration, and later files keep the role their name gives.
    """
    stem = F.lower(file_stem(F.col("path")))
    role = (
        F.when(stem.contains("collar"), "collar")
        .when(stem.contains("pivot"), "pivot")
        .when(stem.contains("assay"), "assay")
        .when(stem.contains("alter"), "alteration")
        .when(stem.contains("geochem"), "geochem")
    )
    named = files.select(group, "path", "ordinal", role.alias("named"))
    first = named.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy("ordinal"))).filter(
        "n <= 3").select(group, "ordinal", F.element_at(
            F.array(F.lit("collar"), F.lit("assay"), F.lit("alteration")), F.col("n")).alias("placed"))
    # one row per group
    has = named.groupBy(group).agg(
        F.bool_or(F.coalesce(F.col("named") == "collar", F.lit(False))).alias("collared"),
        F.bool_or(F.coalesce(F.col("named") == "pivot", F.lit(False))).alias("pivoted"))
    chosen = F.when(F.col("collared"), F.col("named")).otherwise(F.coalesce("placed", "named"))
    return (
        named.join(first, [group, "ordinal"], "left").join(has, group)
        .withColumn("role", chosen)
        .filter(F.col("role").isNotNull() & ~(F.col("pivoted") & (F.col("named") == "assay") & (F.col("role") == "assay")))
        .select(group, F.when(F.col("role") == "pivot", "assay").otherwise(F.col("role")).alias("role"), "path", "ordinal")
    )


def category_rollup(files: DataFrame) -> DataFrame:
    """Files, bytes and extensions per folder and category, with totals."""
    named = with_name_parts(files).withColumn("category", inventory_category(F.col("ext")))
    shown = F.when(F.col("ext") == "", "(none)").otherwise(F.col("ext"))
    return named.rollup("folder", "category").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
        F.array_join(F.sort_array(F.collect_set(shown)), ", ").alias("extensions"),
    )


def storage_report(files: DataFrame, trained: DataFrame) -> DataFrame:
    """Kept and deletable bytes per deposit, a trained flag, and grand totals.

    ``trained`` holds the deposits known to the registry.
    """
    named = with_name_parts(files).withColumns({
        "deposit": deposit_of_folder(F.col("folder")),
        "class": retention_class(F.col("ext")),
    })

    def size(name):
        return F.sum(F.when(F.col("class") == name, F.col("length")).otherwise(F.lit(0)))

    report = named.rollup("deposit").agg(
        size("keep").alias("keep_bytes"), size("deletable").alias("deletable_bytes"),
        F.count(F.lit(1)).alias("files"),
    )
    flags = trained.select("deposit").distinct().withColumn("trained", F.lit(True))
    return report.join(flags, "deposit", "left").fillna(False, subset=["trained"])


def raster_catalogue(files: DataFrame) -> DataFrame:
    """Logical raster keys and the file behind each; the last path counts."""
    named = with_name_parts(files)
    upper = F.upper("name")

    def like_any(patterns):
        return reduce(lambda a, b: a | b, [upper.like(p) for p in patterns])

    keys = [F.when((F.col("ext") == ".jp2") & like_any(p), F.lit(k))
            for k, p in fv.SENTINEL_BANDS]
    keys += [F.when((F.col("ext") == ".tif") & like_any(p), F.lit(k))
             for k, p in fv.LANDSAT_BANDS]
    keys.append(F.when(
        (F.col("ext") == ".img") & F.col("name").like("m2\\_regional%"),
        F.concat(F.lit("y4_"), file_stem(F.col("path")))))
    keys.append(F.when(
        (F.col("ext") == ".tif") & upper.like("%DEM%") & ~F.col("name").contains("Tile")
        & (F.col("length") > 1e6), F.lit("dem")))
    keyed = named.withColumn("key", F.coalesce(*keys)).filter("key IS NOT NULL")
    return keyed.groupBy("key").agg(
        F.max("path").alias("path"), F.count(F.lit(1)).alias("candidates")
    )


def first_match(files: DataFrame, names: list[str], roots: list[str]) -> DataFrame:
    """Per wanted name, the first file below the earliest root that has it."""
    rank = F.coalesce(*[
        F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.lit(i))
        for i, root in enumerate(roots)
    ])
    hits = files.withColumns({"name": file_name(F.col("path")), "root": rank})
    return (
        hits.filter(F.col("name").isin(names) & F.col("root").isNotNull())
        .groupBy("name").agg(F.min_by("path", F.struct("root", "path")).alias("path"))
    )


def latest_file(files: DataFrame, group: str) -> DataFrame:
    """Most recently modified file per group; equal times go to the last path."""
    return files.groupBy(group).agg(
        F.max_by("path", F.struct("mtime", "path")).alias("path"),
        F.max("mtime").alias("mtime"),
    )


def deposit_files(files: DataFrame) -> DataFrame:
    """Files a deposit scan accepts, with the deposit taken from the folder."""
    named = with_name_parts(files)
    return named.filter(F.col("ext").isin(fv.DEPOSIT_EXTENSIONS)).withColumn(
        "deposit", deposit_of_folder(F.col("folder"))
    )


SHOWN_COLUMNS = 25


def header_columns(line: Column) -> Column:
    """All column names of a header line: lower case, blanks and quotes off."""
    line = F.regexp_replace(F.lower(line), r"^\s+|\s+$", "")
    return F.transform(
        F.split(line, ","),
        lambda c: F.regexp_replace(
            F.regexp_replace(c, r"^\s+|\s+$", ""), r'^"+|"+$', ""),
    )


def rare_earth_headers(columns: Column) -> Column:
    """The header names that mention a rare earth."""
    return F.filter(columns, lambda c: contains_any(c, fv.RARE_EARTH_WORDS))


def json_shape(text: Column) -> Column:
    """Short description of a JSON text: keys of an object, length of a list."""
    keys = F.array_join(F.slice(F.json_object_keys(text), 1, 6), ",")
    first = F.get_json_object(text, "$[0]")
    inner = F.array_join(F.slice(F.json_object_keys(first), 1, 5), ",")
    return (
        F.when(F.json_object_keys(text).isNotNull(), F.concat(F.lit("object:"), keys))
        .when(F.json_array_length(text) > 0, F.concat(
            F.lit("list["), F.json_array_length(text).cast("string"), F.lit("]:"),
            F.coalesce(inner, F.lit("scalar"))))
    )
