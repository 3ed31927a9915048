"""Column-level operators: selection, leakage, alignment, imputation, encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks import fixedvalues as fv
from lodeworks.functions.geochem import is_log_scaled, log_grade
from lodeworks.functions.numeric import finite_or_zero
from lodeworks.operators.exact import exact_quantiles


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def reveals_target(name: str) -> bool:
    return any(word in name.lower() for word in fv.LEAKING_WORDS)


def is_target_component(name: str) -> bool:
    return any(name.startswith(f"{oxide}_ppm") for oxide in fv.RARE_EARTH_OXIDES)


def without_leakage(names: list[str], drop_target_components: bool = False) -> list[str]:
    """Names in first-seen order without those that reveal the target."""
    kept = [n for n in dict.fromkeys(names) if not reveals_target(n)]
    if drop_target_components:
        kept = [n for n in kept if not is_target_component(n)]
    return kept


def numeric_features(df: DataFrame, skip: list[str] = fv.NON_FEATURE_COLUMNS) -> list[str]:
    """Numeric columns outside ``skip`` that hold at least one value; one pass."""
    names = [f.name for f in df.schema.fields if is_numeric(f) and f.name not in skip]
    if not names:
        return []
    present = df.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in names]).first()
    return [n for n in names if present[n] > 0]


def column_report(df: DataFrame, skip: list[str] = fv.NON_FEATURE_COLUMNS) -> DataFrame:
    """One row per column: values present, numeric, leaking, chosen as feature."""
    wide = df.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in df.columns])
    rows = []
    for field in df.schema.fields:
        numeric, leaks = is_numeric(field), reveals_target(field.name)
        eligible = numeric and not leaks and field.name not in skip
        rows.append(F.struct(
            F.lit(field.name).alias("name"),
            F.col(f"`{field.name}`").alias("present"),
            F.lit(numeric).alias("is_number"),
            F.lit(leaks).alias("leaks"),
            (F.lit(eligible) & (F.col(f"`{field.name}`") > 0)).alias("chosen"),
        ))
    return wide.select(F.inline(F.array(*rows)))


def aligned(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """``keep`` columns plus exactly ``features`` in order; missing ones are 0."""
    have = set(df.columns)
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        *[
            (F.col(f"`{c}`").cast("double") if c in have else F.lit(0.0)).alias(c)
            for c in features
        ],
    )


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median per column, 0 where a column has no value."""
    return {c: v[0] if v[0] is not None else 0.0
            for c, v in exact_quantiles(df, columns, [0.5]).items()}


def imputed(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """NULL, NaN and infinite values replaced by the given value per column."""
    def fill(name: str, value: float) -> Column:
        c = F.col(f"`{name}`").cast("double")
        return F.when(c.isNotNull() & ~F.isnan(c), finite_or_zero(c)).otherwise(F.lit(value))

    return df.withColumns({n: fill(n, v) for n, v in values.items()})


def log_scaled(df: DataFrame, features: list[str]) -> DataFrame:
    """Log-scale the geochemical features by name."""
    chosen = [c for c in features if is_log_scaled(c) or c.startswith("idw_")]
    return df.withColumns({c: log_grade(F.col(f"`{c}`")) for c in chosen})


def one_hot(df: DataFrame, column: str, limit: int = 10_000) -> DataFrame:
    """0/1 columns per level of a text column, without the first level.

    NULL is the level ``unknown``. The level list is a bounded driver-side
    result and refused beyond ``limit`` levels.
    """
    level = F.coalesce(F.col(column), F.lit("unknown"))
    levels = sorted(
        r[0] for r in df.select(level.alias("v")).distinct().limit(limit + 1).collect()
    )
    if len(levels) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return df.withColumns({
        f"{column}_{v}": (level == F.lit(v)).cast("int") for v in levels[1:]
    })


def matrix_columns(columns: list[str], features: list[str]) -> list[str]:
    """Id and place columns first, then features, each once."""
    spatial = ["hole_id", "deposit", "lat", "lon", "x", "y", "elevation"]
    ordered = dict.fromkeys([*spatial, *features])
    return [c for c in ordered if c in columns]


def robust_statistics(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range per column (range 1 where it is 0)."""
    return robust_ranges(exact_quantiles(df, columns, [0.25, 0.5, 0.75]))


def robust_ranges(quartiles: dict[str, list]) -> dict[str, tuple[float, float]]:
    return {
        c: (q[1] or 0.0, ((q[2] - q[0]) or 1.0) if q[0] is not None else 1.0)
        for c, q in quartiles.items()
    }


def robust_scaled(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (F.col(f"`{c}`") - F.lit(mid)) / F.lit(width) for c, (mid, width) in stats.items()
    })
