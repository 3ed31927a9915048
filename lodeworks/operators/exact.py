"""Exact order statistics and running totals that stay distributed at any size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodeworks.functions.numeric import nan_to_null

# Values (rows times columns) one aggregation buffer may hold before the bracketed
# form takes over, and rows one ordered bucket aims at.
BUFFER_VALUES = 4_000_000
BUCKET_ROWS = 1_000_000
# Accuracy of approximate quantiles: errors of one part in so many.
SKETCH = 1000


def _number(column: str) -> Column:
    return nan_to_null(F.col(f"`{column}`").cast("double"))


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float],
    buffer_values: int = BUFFER_VALUES,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns, NULL and NaN skipped.

    Up to ``buffer_values`` values the built-in exact aggregate holds all distinct
    ones. Beyond that, approximate quantiles bracket each target rank, counts
    prove that the rank lies inside, brackets are narrowed until they are small,
    and only those are sorted. ``df`` is read a few times, so stage what is dear.
    A column without values gives None for each quantile.
    Returns one short list per column (a bounded driver-side result).
    """
    if not columns:
        return {}
    rows = df.count()
    if rows * len(columns) <= buffer_values:
        wanted = F.array(*[F.lit(p) for p in probabilities])
        found = df.agg(
            *[F.percentile(_number(c), wanted).alias(c) for c in columns]
        ).first()
        return {c: list(found[c] or [None] * len(probabilities)) for c in columns}
    return _bracketed(df, columns, probabilities, rows, buffer_values)


def _bracketed(df, columns, probabilities, rows, buffer_values):
    """Quantiles by brackets that are narrowed until their rows fit one ordered task.

    Sketches have a fixed error, so driver and tasks hold the same few numbers for
    any number of rows; a bracket narrows some hundred times a round.
    """
    doubles = df.select(*[_number(c).alias(c) for c in columns])
    filled = doubles.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{j}") for j, c in enumerate(columns)]).first()
    sizes = {c: filled[f"n{j}"] for j, c in enumerate(columns)}
    keys = [(c, i) for c in columns if sizes[c] for i in range(len(probabilities))]
    if not keys:
        return {c: [None] * len(probabilities) for c in columns}
    limit = max(buffer_values // len(keys), 1)
    brackets = {k: (-math.inf, math.inf) for k in keys}
    counts = {k: (0, sizes[k[0]]) for k in keys}  # values below the bracket, and in it
    ranks = {(c, i): probabilities[i] * (sizes[c] - 1) for c, i in keys}
    margins, open_keys = {k: 2 / SKETCH for k in keys}, set(keys)

    def inside(k, ends):
        return F.col(f"`{k[0]}`").between(F.lit(ends[0]), F.lit(ends[1]))

    while open_keys := {k for k in open_keys if counts[k][1] > limit}:
        order = sorted(open_keys)
        wanted = []
        for k in order:
            below, n = counts[k]
            low, high = (math.floor(ranks[k]) - below) / n, (math.ceil(ranks[k]) + 1 - below) / n
            shares = [max(low - margins[k], 0.0), min(high + margins[k], 1.0)]
            wanted.append(F.percentile_approx(
                F.when(inside(k, brackets[k]), F.col(f"`{k[0]}`")), shares, SKETCH))
        found = [tuple(x) for x in doubles.agg(*[w.alias(f"e{m}") for m, w in enumerate(wanted)]).first()]
        new = doubles.agg(*[
            x for m, k in enumerate(order) for x in (
                F.count_if(F.col(f"`{k[0]}`") < F.lit(found[m][0])).alias(f"below{m}"),
                F.count_if(inside(k, found[m])).alias(f"inside{m}"))
        ]).first()
        for m, k in enumerate(order):
            below, n = new[f"below{m}"], new[f"inside{m}"]
            if not (below <= math.floor(ranks[k]) and math.ceil(ranks[k]) < below + n):
                margins[k] *= 4  # the sketch was off; the bracket stays
                if margins[k] > 1:
                    open_keys.discard(k)
            elif n == counts[k][1]:
                open_keys.discard(k)  # equal values, one row once grouped
            else:
                brackets[k], counts[k] = found[m], (below, n)
    targets = {k: (ranks[k], counts[k][0]) for k in keys}
    held = list(brackets.items())
    # few values lie in a bracket, so the others are dropped before rows are made of them
    inside_one = F.filter(F.array(*[
        F.struct(
            F.lit(m).alias("m"),
            F.when(F.col(f"`{c}`").between(F.lit(low), F.lit(high)), F.col(f"`{c}`")).alias("v"))
        for m, ((c, _), (low, high)) in enumerate(held)
    ]), lambda s: s["v"].isNotNull())

    def of_bracket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("m") + 1)

    values = (
        doubles.select(F.explode(inside_one).alias("s")).select("s.*")
        .groupBy("m", "v").agg(F.count(F.lit(1)).alias("n"))
        .select(
            of_bracket([columns.index(c) for (c, _), _ in held]).alias("j"),
            of_bracket([i for (_, i), _ in held]).alias("i"),
            of_bracket([math.floor(targets[k][0]) - targets[k][1] for k, _ in held]).alias("first"),
            of_bracket([math.ceil(targets[k][0]) - targets[k][1] for k, _ in held]).alias("last"),
            "v", "n")
    )
    upto = F.sum("n").over(W.partitionBy("j", "i").orderBy("v"))
    picked = (
        values.withColumn("upto", upto).filter(F.col("upto") > F.col("first"))
        .groupBy("j", "i")
        .agg(
            F.min("v").alias("low"),
            F.min(F.when(F.col("upto") > F.col("last"), F.col("v"))).alias("high"),
        )
        .collect()
    )
    out = {c: [None] * len(probabilities) for c in columns}
    for row in picked:
        rank, _ = targets[(columns[row["j"]], row["i"])]
        share = rank - math.floor(rank)
        out[columns[row["j"]]][row["i"]] = row["low"] + (row["high"] - row["low"]) * share
    return out


def quantile(df: DataFrame, column: str, p: float) -> float | None:
    return exact_quantiles(df, [column], [p])[column][0]


class _Search:
    """The values at some ranks of one column, by cells that are cut finer round after round."""

    def __init__(self, sizes: dict, ranks: list[tuple]):
        self.sizes = sizes  # values of each fold
        # a target: the fold left out (None: none), the rank, its bracket, values below that
        self.open = {t: (-math.inf, math.inf, {f: 0 for f in sizes}) for t in ranks}
        self.found = {}

    def brackets(self) -> list[tuple[float, float]]:
        return sorted({(low, high) for low, high, _ in self.open.values()})

    def narrow(self, cells: dict[tuple, list]) -> None:
        """``cells`` has, per bracket, rows (cell, fold, n, least, most) in any order."""
        for target, (low, high, below) in list(self.open.items()):
            left_out, rank = target
            seen, groups = dict(below), {}
            for cell, fold, n, least, most in cells.get((low, high), ()):
                groups.setdefault(cell, []).append((fold, n, least, most))
            for cell in sorted(groups):
                held = {}
                for fold, n, _, _ in groups[cell]:
                    held[fold] = held.get(fold, 0) + n
                upto = sum(n + held.get(f, 0) for f, n in seen.items() if f != left_out)
                if rank < upto:
                    ends = (min(g[2] for g in groups[cell]), max(g[3] for g in groups[cell]))
                    if ends[0] == ends[1]:
                        self.found[target] = ends[0]
                        del self.open[target]
                    else:
                        self.open[target] = (*ends, seen)
                    break
                for f, n in held.items():
                    seen[f] += n


CELLS = 1024
#: Counts that a task adds up before it passes them on.
HELD_COUNTS = 200_000


def held_out_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], fold: str, cells: int = CELLS,
) -> dict:
    """Interpolated quantiles of every column over all rows but those of one fold, for each fold.

    Returns {fold: {column: quantiles}}, and under None those of all rows. Only finite numbers
    count; without any, a quantile is None. All training sets share one search: values are
    counted by cell and fold in ``cells`` cells of a bracket, the counts of all folds but one
    tell in which cell a rank of that training set lies, and that cell is the next bracket.
    Brackets end at values, so the result is exact; a round brings back at most ``cells``
    counts per column, fold and bracket.
    """
    if not columns:
        return {None: {}}
    number = [_number(c) for c in columns]
    usable = [F.when(F.abs(x) < float("inf"), x).alias(f"v{j}") for j, x in enumerate(number)]
    values = df.select(F.col(fold).alias("fold"), *usable)
    sizes = {r["fold"]: r for r in values.groupBy("fold").agg(
        *[F.count(f"v{j}").alias(f"n{j}") for j in range(len(columns))]).collect()}
    ranks, searches = {}, []
    for j in range(len(columns)):
        per_fold = {f: r[f"n{j}"] for f, r in sizes.items()}
        for left_out in [None, *sizes]:
            n = sum(m for f, m in per_fold.items() if f != left_out or left_out is None)
            for i, p in enumerate(probabilities):
                if n:
                    ranks[j, left_out, i] = p * (n - 1)
        wanted = {(k, r) for (c, k, _), at in ranks.items() if c == j for r in (math.floor(at), math.ceil(at))}
        searches.append(_Search(per_fold, sorted(wanted, key=str)))
    first = True
    while any(s.open for s in searches):
        asked = [(j, low, high) for j, s in enumerate(searches) for low, high in s.brackets()]
        counted = _cell_counts(values, asked, cells, first)
        for j, s in enumerate(searches):
            s.narrow({(low, high): counted.get((j, low, high), []) for low, high in s.brackets()})
        first = False
    out = {k: {c: [None] * len(probabilities) for c in columns} for k in [None, *sizes]}
    for (j, left_out, i), at in ranks.items():
        found = searches[j].found
        low, high = found[left_out, math.floor(at)], found[left_out, math.ceil(at)]
        out[left_out][columns[j]][i] = low + (high - low) * (at - math.floor(at))
    return out


def _cell_counts(values: DataFrame, asked: list[tuple], cells: int, first: bool) -> dict[tuple, list]:
    """Counts, least and greatest value by bracket, cell and fold.

    A task adds its rows up before they are grouped, HELD_COUNTS counts at a time.
    """
    def table(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*((*k, *c) for k, c in held.items())), kinds)],
            names=["m", "cell", "fold", "n", "least", "most"])

    def counted(batches):
        held: dict = {}
        for batch in batches:
            folds = batch.column(0).dictionary_encode()
            names, codes = folds.dictionary.to_pylist(), folds.indices.fill_null(len(folds.dictionary)).to_numpy()
            names.append(None)
            for m, (j, low, high) in enumerate(asked):
                v = batch.column(1 + j).to_numpy(zero_copy_only=False)
                # NaN stands for null
                at = np.flatnonzero((v >= low) & (v <= high))
                if not len(at):
                    continue
                v = v[at]
                if first:  # brackets without ends: all values of a column are one cell each
                    cell = np.zeros(len(v), np.int64)
                else:
                    # the halves keep the width of a bracket finite; cells never fall as values rise
                    share = (v / 2 - low / 2) / max(high / 2 - low / 2, 5e-324)
                    cell = np.minimum(np.floor(share * cells), cells - 1).astype(np.int64)
                    cell[v == low] = -1
                    cell[v == high] = cells
                group = codes[at] * (cells + 2) + cell + 1
                order = np.argsort(group, kind="stable")
                group, v = group[order], v[order]
                start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                sizes = np.diff(np.append(start, len(v)))
                for g, n, least, most in zip(
                    group[start].tolist(), sizes.tolist(), np.minimum.reduceat(v, start).tolist(),
                    np.maximum.reduceat(v, start).tolist(),
                ):
                    key = (m, g % (cells + 2) - 1, names[g // (cells + 2)])
                    was = held.get(key)
                    held[key] = (n, least, most) if was is None else (
                        was[0] + n, min(was[1], least), max(was[2], most))
                if len(held) > HELD_COUNTS:
                    yield table(held)
                    held = {}
        if held:
            yield table(held)

    fold = values.schema["fold"].dataType
    kinds = [pa.int32(), pa.int64(), to_arrow_type(fold), pa.int64(), pa.float64(), pa.float64()]
    rows = values.mapInArrow(
        counted, f"m int, cell long, fold {fold.simpleString()}, n long, least double, most double",
    ).groupBy("m", "cell", "fold").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    out: dict[tuple, list] = {}
    for r in rows.collect():
        out.setdefault(asked[r["m"]], []).append((r["cell"], r["fold"], r["n"], r["least"], r["most"]))
    return out


def running_totals(
    df: DataFrame, order: str, sums: list[str], descending: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Inclusive running sums ``<name>_run`` along distinct values of ``order``.

    Two levels: a window inside value buckets of about ``bucket_rows`` rows, plus
    the totals of the buckets before. ``df`` holds one row per value of
    ``order``, so no bucket can be swamped by one value.
    """
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    buckets = math.ceil(df.count() / bucket_rows)
    inner = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        inner = sorted(set(df.approxQuantile(order, shares, 1 / (4 * buckets))))
    if not inner:
        # At most one bucket of rows: one ordered task is enough.
        whole = W.orderBy(direction(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({f"{s}_run": F.sum(s).over(whole) for s in sums})
    splits = [-float("inf"), *inner, float("inf")]
    # NaN comes after all numbers, in a bucket of its own, as one ordered window has it
    marked = Bucketizer(
        splits=splits, inputCol=order, outputCol="_bucket", handleInvalid="keep").transform(df)
    # One row per bucket, so this window never sees the rows of df.
    earlier = W.orderBy(direction("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("_bucket").agg(*[F.sum(s).alias(s) for s in sums])
        .select("_bucket", *[
            F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums
        ])
    )
    within = W.partitionBy("_bucket").orderBy(direction(order)).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    return (
        marked.join(F.broadcast(offsets), "_bucket")
        .withColumns({
            f"{s}_run": F.sum(s).over(within) + F.col(f"_before_{s}") for s in sums
        })
        .drop("_bucket", *[f"_before_{s}" for s in sums])
    )
