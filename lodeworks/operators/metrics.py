"""Model metrics, curves, histograms and data-health figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.numeric import clip
from lodeworks.operators.exact import exact_quantiles, quantile, running_totals
from lodeworks.session import stage_table


def regression_metrics(df: DataFrame, label: str, predictions: list[str]) -> DataFrame:
    """R2 and RMSE of each prediction column, all in one aggregation."""
    y = F.col(label)
    scores = df.agg(
        *[F.sum((y - F.col(p)) ** 2).alias(f"ss_{p}") for p in predictions],
        (F.var_pop(y) * F.count(y)).alias("ss_total"),
        F.count(y).alias("rows"),
    )
    return scores.select(
        F.inline(F.array(*[
            F.struct(
                F.lit(p).alias("model"),
                (F.lit(1.0) - F.try_divide(F.col(f"ss_{p}"), F.col("ss_total"))).alias("r2"),
                F.sqrt(F.col(f"ss_{p}") / F.col("rows")).alias("rmse"),
            )
            for p in predictions
        ]))
    )


def score_counts(df: DataFrame, label: Column, score: str) -> DataFrame:
    """Positives and negatives per distinct score, staged for several readers."""
    counts = df.filter(F.col(score).isNotNull() & label.isNotNull()).groupBy(score).agg(
        F.count_if(label).alias("pos"), F.count_if(~label).alias("neg")
    )
    return stage_table(counts, "score-counts")


def roc_auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """Exact area under the ROC curve with tied scores counted half; one row."""
    runs = running_totals(score_counts(df, label, score), score, ["neg"])
    won = F.col("pos") * (F.col("neg_run") - F.col("neg") / F.lit(2.0))
    return runs.agg(
        F.try_divide(F.sum(won), F.sum("pos") * F.sum("neg").cast("double")).alias("roc_auc"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )


def score_curve(df: DataFrame, label: Column, score: str) -> DataFrame:
    """ROC and precision-recall points, one row per distinct score."""
    counts = score_counts(df, label, score)
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    runs = running_totals(counts, score, ["pos", "neg"], descending=True)
    positives, negatives = float(totals["p"] or 0), float(totals["n"] or 0)
    return runs.select(
        F.col(score).alias("threshold"),
        F.try_divide(F.col("neg_run"), F.lit(negatives)).alias("fpr"),
        F.try_divide(F.col("pos_run"), F.lit(positives)).alias("tpr"),
        (F.col("pos_run") / (F.col("pos_run") + F.col("neg_run"))).alias("precision"),
        F.try_divide(F.col("pos"), F.lit(positives)).alias("recall_step"),
    )


def average_precision(curve: DataFrame) -> DataFrame:
    return curve.agg(F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"))


def is_high_grade(df: DataFrame, label: str, share: float = 0.70) -> Column:
    """True at and above the given quantile of the label."""
    return F.col(label) >= F.lit(quantile(df, label, share))


def model_spread(df: DataFrame, predictions: list[str]) -> DataFrame:
    """Population std over models per row as ``spread``."""
    models = F.lit(float(len(predictions)))
    mean = reduce(lambda a, b: a + b, [F.col(p) for p in predictions]) / models
    squares = reduce(lambda a, b: a + b, [(F.col(p) - mean) ** 2 for p in predictions])
    return df.withColumn("spread", F.sqrt(squares / models))


def model_agreement(df: DataFrame, predictions: list[str]) -> DataFrame:
    """Spread and confidence per row; the widest spread sets the scale."""
    spread = model_spread(df, predictions)
    widest = spread.agg(F.max("spread")).first()[0] or 0.0
    return spread.withColumn(
        "confidence", clip(F.lit(1.0) - F.col("spread") / F.lit(widest + 1e-6), 0.0, 1.0)
    )


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Equal-width counts; the top edge belongs to the last bin."""
    width = (high - low) / bins
    position = F.floor((F.col(value) - F.lit(low)) / F.lit(width)).cast("int")
    return (
        df.filter(F.col(value).between(low, high))
        .groupBy(F.least(position, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("bin_start", F.lit(low) + F.col("bin") * F.lit(width))
    )


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Actual-versus-predicted rows with the residual and its band."""
    residual = F.col(prediction) - F.col(label)
    band = F.when(F.abs(residual) < 0.1, "close").when(F.abs(residual) < 0.2, "near")
    return df.withColumns({"residual": residual, "band": band.otherwise("far")})


def data_health(df: DataFrame, treo: str, lat: str = "lat") -> DataFrame:
    """Null share, coordinate range faults and unusually high grades; one row."""
    high = quantile(df, treo, 0.99)
    shares = [F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in df.columns]
    missing = reduce(lambda a, b: a + b, shares) / F.lit(float(len(shares))) * F.lit(100.0)
    return df.agg(
        F.count(F.lit(1)).alias("holes"),
        missing.alias("missing_pct"),
        F.count_if((F.col(lat) < -90) | (F.col(lat) > 90)).alias("coord_outliers"),
        F.count_if(F.col(treo) > F.lit(high)).alias("high_grades"),
    ).withColumn("healthy", F.col("missing_pct") < 20)


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max, mean, sample std and median per column, one row per column."""
    medians = exact_quantiles(df, columns, [0.5])
    wide = df.agg(*[
        agg(F.col(f"`{c}`")).alias(f"{name}_{i}")
        for i, c in enumerate(columns)
        for name, agg in (
            ("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_samp),
            ("n", F.count),
        )
    ])
    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("name"), F.col(f"n_{i}").alias("present"),
            F.col(f"min_{i}").alias("low"), F.col(f"max_{i}").alias("high"),
            F.col(f"avg_{i}").alias("mean"), F.col(f"std_{i}").alias("std"),
            F.lit(medians[c][0]).cast("double").alias("median"),
        )
        for i, c in enumerate(columns)
    ])))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Present and non-zero counts, mean and population std per column."""
    wide = df.agg(*[
        expr.alias(f"{name}_{i}")
        for i, c in enumerate(columns)
        for name, expr in (
            ("present", F.count(F.col(f"`{c}`"))),
            ("nonzero", F.count_if(F.abs(F.col(f"`{c}`")) > 0.001)),
            ("mean", F.avg(F.col(f"`{c}`"))),
            ("std", F.stddev_pop(F.col(f"`{c}`"))),
        )
    ])
    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("name"),
            *[F.col(f"{n}_{i}").alias(n) for n in ("present", "nonzero", "mean", "std")],
        )
        for i, c in enumerate(columns)
    ])))


def linear_impact(
    df: DataFrame, weights: dict[str, float], top: int | None = None
) -> DataFrame:
    """Mean absolute contribution w * (x - mean) of each feature of a linear model."""
    means = df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in weights]).first()
    wide = df.agg(*[
        F.avg(F.abs(F.lit(w) * (F.col(f"`{c}`") - F.lit(means[c])))).alias(c)
        for c, w in weights.items()
    ])
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("impact")) for c in weights
    ])))
    if top:
        rows = rows.orderBy(F.col("impact").desc(), "feature").limit(top)
    return rows


def f_scores(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Univariate regression F value per feature, from one pass of correlations."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.corr(F.col(f"`{c}`"), F.col(label)).alias(c) for c in features],
    )
    r2 = F.col("r") * F.col("r")
    return wide.select("n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("r")) for c in features
    ]))).select(
        "feature",
        F.try_divide(r2 * (F.col("n") - F.lit(2)), F.lit(1.0) - r2).alias("f_score"),
    )
