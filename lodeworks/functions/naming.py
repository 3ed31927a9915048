"""Schema resolution by column name. Works on names only, never on rows."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks import fixedvalues as fv

FUZZY_CUTOFF = 0.8


def standard_names(columns: list[str], join_words: bool = True) -> list[str]:
    """Trim, lower-case and underscore names; repeated names get a number."""
    used: dict[str, int] = {}
    out = []
    for column in columns:
        name = column.strip().lower()
        if join_words:
            name = name.replace(" ", "_")
        used[name] = used.get(name, 0) + 1
        out.append(name if used[name] == 1 else f"{name}_{used[name]}")
    return out


def hole_id_column(columns: list[str]) -> str:
    """The collar's id column: first hit in the priority list, else the first column."""
    hits = [name for name in fv.HOLE_ID_PRIORITY if name in columns]
    return hits[0] if hits else columns[0]


def hole_key_column(columns: list[str]) -> str:
    """The join column of an assay-like table."""
    hits = [c for c in columns if any(part in c for part in fv.HOLE_KEY_PARTS)]
    return hits[0] if hits else columns[0]


def coordinate_columns(columns: list[str]) -> dict[str, str | None]:
    """Names of the latitude, longitude, easting and northing columns."""

    def first(test):
        return next((c for c in columns if test(c)), None)

    return {
        "lat": first(lambda c: c in fv.LATITUDE_NAMES),
        "lon": first(lambda c: c in fv.LONGITUDE_NAMES),
        "easting": first(lambda c: "easting" in c or c == "x"),
        "northing": first(lambda c: "northing" in c or c == "y"),
    }


def oxide_stem(name: str) -> str:
    """A column name without case, unit suffix and outer blanks."""
    return name.lower().replace("_ppm", "").replace("_pct", "").strip()


def _symbol(oxide: str) -> str:
    return re.sub(r"\d*o\d+$", "", oxide)


def match_oxide(name: str) -> str | None:
    """Canonical rare-earth oxide for a loosely written name, or None.

    A close spelling counts only when it starts with the oxide's own element
    symbol, so that alumina or iron oxide never passes for a rare earth.
    """
    stem = oxide_stem(name)
    if stem in fv.RARE_EARTH_OXIDES:
        return stem
    for oxide in difflib.get_close_matches(
        stem, fv.RARE_EARTH_OXIDES, n=len(fv.RARE_EARTH_OXIDES), cutoff=FUZZY_CUTOFF
    ):
        rest = stem.removeprefix(_symbol(oxide))
        if rest != stem and not re.match(r"[a-np-z]", rest):
            return oxide
    return None


def oxide_sources(columns: list[str]) -> dict[str, str]:
    """Canonical ``<oxide>_ppm`` name to source column; exact spellings win."""
    out: dict[str, str] = {}
    ranked = sorted(columns, key=lambda c: oxide_stem(c) not in fv.RARE_EARTH_OXIDES)
    for column in ranked:
        oxide = match_oxide(column)
        if oxide:
            out.setdefault(f"{oxide}_ppm", column)
    return out


def folder_name(path: Column) -> Column:
    """Name of the folder that holds a file."""
    return F.element_at(F.split(path, "/"), -2)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def normal_name(text: Column) -> Column:
    """Lower case with blanks and hyphens as underscores."""
    return F.translate(F.lower(text), " -", "__")


def word_array(words: list[str]) -> Column:
    """A constant array of plain words."""
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def words_in(text: Column, words: list[str]) -> Column:
    """The words of the list that occur in the text, in list order."""
    return F.filter(word_array(words), lambda w: text.contains(w))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(word_array(words), lambda w: text.contains(w))
