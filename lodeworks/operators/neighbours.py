"""Exact k-nearest-neighbour join and inverse-distance interpolation.

Both sides are numbered along one space-filling curve. Sites are cut into runs of a
fixed number, however dense a spot is; places are cut so that no query run reaches past
a run of sites. Runs of sites carry bounding boxes, and boxes of boxes above them; query
runs walk down that hierarchy and keep only boxes that can still hold one of their k
nearest sites, and each place prunes what its run kept by a bound of its own. Each step
is an equi-join on the box id followed by a window per query run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks import fixedvalues as fv
from lodeworks.functions.geochem import idw_confidence, idw_weight
from lodeworks.operators.skew import salted_join
from lodeworks.session import stage_table

SITE_RUN = 32
QUERY_RUN = 32
BOXES_PER_BOX = 16
# A hierarchy level of at most this many boxes is broadcast; its size is known
# exactly from the site count before the join is planned.
BROADCAST_BOXES = 50_000
CURVE_BITS = 31
# Coordinate range the curve resolves: degrees, or metres of a projected zone.
DEGREES = 360.0
METRES = 2e7
# Fewer boxes than this are cheaper to work out again than to write.
SMALL_LEVEL = 4096
# Places and candidate runs that one task compares.
PAIRS_PER_TASK = 4096


def _spread(bits: Column) -> Column:
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
    return bits


def _curve_key(extent: float) -> Column:
    """Interleaved bits of both coordinates, cut to -extent..extent.

    Coordinates beyond the extent are still found, only less well packed.
    """
    steps = float(2**CURVE_BITS - 1)

    def cell(c):
        inside = F.greatest(F.least(F.col(c), F.lit(extent)), F.lit(-extent))
        return F.floor((inside + F.lit(extent)) * F.lit(steps / (2 * extent))).cast("long")

    return _spread(cell("x")).bitwiseOR(F.shiftleft(_spread(cell("y")), 1))


def _in_runs(sites: DataFrame, places: DataFrame, extent: float) -> tuple[DataFrame, int]:
    """Sites and places numbered along one curve: ``run`` of a site, ``qrun`` of a place.

    A run is SITE_RUN sites in a row. A query run is at most QUERY_RUN places in a row that
    lie within one run of sites, so where places are rarer than sites it is a single place.
    Returns the staged rows (sites have a ``site_id``) and the number of runs.
    """
    both = sites.withColumn("_q", F.lit(0)).unionByName(
        places.withColumn("_q", F.lit(1)), allowMissingColumns=True)
    order = ["_curve", "x", "y", "_q", "site_id"]
    sorted_rows = (
        both.withColumn("_curve", _curve_key(extent))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    staged = stage_table(sorted_rows.drop("_curve"), "curve")
    part = F.shiftright("_place", 33).alias("_part")
    # One row per partition of the sorted table.
    sizes = staged.groupBy(part).agg(
        F.sum(1 - F.col("_q")).alias("sites"), F.sum("_q").alias("places"))
    starts, before, asked = [], 0, 0
    for r in sorted(sizes.collect(), key=lambda r: r["_part"]):
        starts.append((r["_part"], before, asked))
        before, asked = before + r["sites"], asked + r["places"]
    offsets = F.broadcast(staged.sparkSession.createDataFrame(
        starts, "_part long, _sites0 long, _places0 long"))
    so_far = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = (
        staged.withColumn("_part", part).join(offsets, "_part")
        .withColumns({
            "_s": F.col("_sites0") + F.sum(1 - F.col("_q")).over(so_far),
            "_p": F.col("_places0") + F.sum("_q").over(so_far),
        })
        .withColumn("run", F.expr(f"(_s - 1) div {SITE_RUN}"))
        # both terms never fall along the curve, so their sum tells all pairs apart
        .withColumn("qrun", F.expr(f"_s div {SITE_RUN} + (_p - 1) div {QUERY_RUN}"))
        .select(*sites.columns, "_q", "run", "qrun")
    )
    return stage_table(numbered, "curve-runs"), math.ceil(before / SITE_RUN)


def _boxes(df: DataFrame, key: Column) -> DataFrame:
    from_points = "x" in df.columns
    low_x, high_x = ("x", "x") if from_points else ("x0", "x1")
    low_y, high_y = ("y", "y") if from_points else ("y0", "y1")
    return df.groupBy(key.alias("box")).agg(
        F.min(low_x).alias("x0"), F.max(high_x).alias("x1"),
        F.min(low_y).alias("y0"), F.max(high_y).alias("y1"),
        (F.count(F.lit(1)) if from_points else F.sum("held")).alias("held"),
    )


def _gap(low_a, high_a, low_b, high_b) -> Column:
    return F.greatest(F.lit(0.0), low_b - high_a, low_a - high_b)


def _reach(low_a, high_a, low_b, high_b) -> Column:
    return F.greatest(high_b - low_a, high_a - low_b)


def _pruned(pairs: DataFrame, k: int, per: list[str], low: list[str], high: list[str]) -> DataFrame:
    """Keep boxes no farther than the reach that already covers k sites.

    ``low`` and ``high`` name the corners of what is searched from, ``per`` its key.
    """
    c = F.col
    near_x = _gap(c(low[0]), c(high[0]), c("x0"), c("x1"))
    near_y = _gap(c(low[1]), c(high[1]), c("y0"), c("y1"))
    far_x = _reach(c(low[0]), c(high[0]), c("x0"), c("x1"))
    far_y = _reach(c(low[1]), c(high[1]), c("y0"), c("y1"))
    one = W.partitionBy(*per)
    nearest_first = one.orderBy("far", "box").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        pairs.withColumns({
            "near": near_x * near_x + near_y * near_y,
            "far": far_x * far_x + far_y * far_y,
        })
        .withColumn("covered", F.sum("held").over(nearest_first))
        .withColumn("bound", F.min(F.when(c("covered") >= k, c("far"))).over(one))
        .filter(c("bound").isNull() | (c("near") <= c("bound") * F.lit(1 + 1e-9)))
    )


def candidates(
    places: DataFrame, sites: DataFrame, k: int, payload: list[str] = (), extent: float = DEGREES,
) -> tuple[DataFrame, DataFrame]:
    """Sites in runs, and the runs (x, y, run, bound) in which each distinct place must look.

    Query runs walk down the boxes of runs; at the end each place has a bound of its own.
    """
    located = sites.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    # Of the sites at one spot only the k smallest ids can ever be chosen.
    same_spot = W.partitionBy("x", "y").orderBy("site_id")
    usable = (
        located.select("site_id", "x", "y", *payload)
        .withColumn("_n", F.row_number().over(same_spot)).filter(F.col("_n") <= k).drop("_n")
    )
    distinct = (
        places.select("x", "y")
        .filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").distinct()
    )
    rows, site_runs = _in_runs(usable, distinct, extent)
    points = rows.filter("_q = 0").select("run", "site_id", "x", "y", *payload)
    wanted = rows.filter("_q = 1").select("qrun", "x", "y")

    leaves = _boxes(points, F.col("run"))
    if site_runs > SMALL_LEVEL:
        leaves = stage_table(leaves, "site-boxes")
    levels = [(leaves, site_runs)]
    while levels[-1][1] > 1:
        below, size = levels[-1]
        parents = _boxes(below, F.expr(f"box div {BOXES_PER_BOX}"))
        levels.append((parents, math.ceil(size / BOXES_PER_BOX)))

    if len(levels) > 1:
        levels.pop()  # the single box over everything decides nothing
    frontier = wanted.groupBy("qrun").agg(
        F.min("x").alias("qx0"), F.max("x").alias("qx1"),
        F.min("y").alias("qy0"), F.max("y").alias("qy1"),
    ).withColumn("first", F.lit(0).cast("long"))
    for boxes, size in reversed(levels):
        # Boxes under one parent are numbered in a row; numbers past the end
        # find no partner in the join.
        last = F.col("first") + F.lit(BOXES_PER_BOX - 1)
        asked = frontier.withColumn("box", F.explode(F.sequence("first", last))).drop("first")
        if size <= BROADCAST_BOXES:
            boxes = F.broadcast(boxes)
        kept = _pruned(asked.join(boxes, "box"), k, ["qrun"], ["qx0", "qy0"], ["qx1", "qy1"])
        frontier = kept.select(
            "qrun", "qx0", "qx1", "qy0", "qy1",
            (F.col("box") * F.lit(BOXES_PER_BOX)).alias("first"),
        )
    # A query run is at most QUERY_RUN places; pairs stay where their query run is.
    each = wanted.join(kept.select("qrun", "box", "x0", "x1", "y0", "y1", "held"), "qrun")
    pairs = _pruned(each, k, ["qrun", "x", "y"], ["x", "y"], ["x", "y"])
    return points, pairs.select("x", "y", F.col("box").alias("run"), "bound")


def nearest_by_place(
    places: DataFrame, sites: DataFrame, k: int, payload: list[str] = (),
    extent: float = DEGREES,
) -> DataFrame:
    """The k nearest sites of every distinct place.

    ``places`` has x, y; ``sites`` has site_id, x, y and the payload columns.
    Distances are Euclidean in the coordinates' own unit; equal distances go to
    the smaller site id. ``extent`` is DEGREES or METRES. Returns x, y and ``near``, an array of at most k
    structs (d, site_id, payload...) in that order.
    """
    points, pairs = candidates(places, sites, k, payload, extent)
    pairs = stage_table(pairs, "place-runs")
    # Few bytes but much arithmetic per row: adaptive execution would put a small
    # search into one task, so its pairs are dealt out first.
    slots = places.sparkSession.sparkContext.defaultParallelism
    if pairs.count() < slots * PAIRS_PER_TASK:
        pairs = pairs.repartition(slots)
    # A run is at most SITE_RUN points, so the array is of fixed size.
    packed = points.groupBy("run").agg(
        F.collect_list(F.struct("x", "y", "site_id", *payload)).alias("members")
    )
    c = F.col
    dx, dy = c("member.x") - c("x"), c("member.y") - c("y")
    square = dx * dx + dy * dy
    found = (
        salted_join(pairs, packed, "run", ["x", "y"])
        .select("x", "y", "bound", F.explode("members").alias("member"))
        # the slack covers rounding
        .filter(c("bound").isNull() | (square <= c("bound") * F.lit(1 + 1e-9)))
        .select(
            "x", "y", F.sqrt(square).alias("d"), c("member.site_id").alias("site_id"),
            *[c(f"member.{p}").alias(p) for p in payload])
    )
    nearest_first = W.partitionBy("x", "y").orderBy("d", "site_id")
    # Spark cuts every place to k rows before the shuffle, and again after it.
    best = found.withColumn("_n", F.row_number().over(nearest_first)).filter(c("_n") <= k)
    return best.groupBy("x", "y").agg(
        F.sort_array(F.collect_list(F.struct("d", "site_id", *payload))).alias("near"))


def nearest_sites(
    queries: DataFrame, sites: DataFrame, k: int, query_id: str, payload: list[str] = ()
) -> DataFrame:
    """One row per query and neighbour: query id, rank, site_id, d, payload."""
    near = nearest_by_place(queries, sites, k, payload)
    return (
        queries.select(query_id, "x", "y").join(near, ["x", "y"])
        .select(query_id, F.posexplode("near").alias("_pos", "_n"))
        .select(
            query_id, (F.col("_pos") + 1).alias("rank"), "_n.site_id", "_n.d",
            *[F.col(f"_n.{p}").alias(p) for p in payload],
        )
    )


def idw(
    queries: DataFrame, sites: DataFrame, values: list[str],
    k: int = fv.NEIGHBOURS, prefix: str = "idw_",
) -> DataFrame:
    """Add inverse-distance estimates of ``values`` and their confidence.

    A missing site value counts as 0. Queries without coordinates keep NULL.
    All value columns come out of one neighbour search.
    """
    filled = sites.select(
        "site_id", "x", "y", *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values]
    )
    near = nearest_by_place(queries, filled, k, values)
    weights = F.aggregate(
        "near", F.lit(0.0), lambda acc, n: acc + idw_weight(n["d"])
    )

    def estimate(name: str) -> Column:
        total = F.aggregate(
            "near", F.lit(0.0), lambda acc, n: acc + idw_weight(n["d"]) * n[name]
        )
        return (total / F.col("_w")).alias(f"{prefix}{name}")

    surface = near.withColumn("_w", weights).select(
        "x", "y", *[estimate(v) for v in values],
        idw_confidence(F.col("near")[0]["d"]).alias("idw_conf"),
        (F.col("near")[0]["d"] * F.lit(fv.METRES_PER_DEGREE)).alias("nearest_m"),
    )
    # Queries without a place would meet in one task of the join.
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    found = queries.filter(placed).join(surface, ["x", "y"], "left")
    return found.unionByName(
        queries.filter(~F.coalesce(placed, F.lit(False))), allowMissingColumns=True)
