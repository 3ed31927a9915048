"""Cross-validation folds that keep neighbouring holes together."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.session import stage_table

# Number of groups and folds, and the seed.
MAX_GROUPS = 10
HOLES_PER_GROUP = 4
MIN_HOLES_FOR_GROUPS = 10
MAX_FOLDS = 5
SEED = 42
# Groups that may stand in an expression.
LISTED_GROUPS = 1000


def hashed_fold(key: Column, folds: int, seed: int = SEED) -> Column:
    """Fold number from a digest of the key: stable, and the same on any engine."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast(
        "int")


def spatial_groups(
    holes: DataFrame, key: str = "hole_id", rows: int | None = None, seed: int = SEED
) -> DataFrame:
    """Add ``group``: spatial clusters, or one group per located hole when those are few.

    Holes without coordinates form one more group of their own.
    """
    located = holes.filter("lon IS NOT NULL AND lat IS NOT NULL")
    rows = located.count() if rows is None else rows
    if rows < MIN_HOLES_FOR_GROUPS:
        placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
        return holes.withColumn(
            "group", F.when(placed, F.col(key).cast("string")).otherwise("unplaced"))
    k = min(MAX_GROUPS, rows // HOLES_PER_GROUP)
    assembler = VectorAssembler(inputCols=["lon", "lat"], outputCol="_place")
    model = KMeans(k=k, seed=seed, featuresCol="_place", predictionCol="_cluster").fit(
        assembler.transform(located)
    )
    clustered = model.transform(assembler.transform(located)).select(
        *holes.columns, F.col("_cluster").cast("string").alias("group")
    )
    unplaced = holes.filter("lon IS NULL OR lat IS NULL").withColumn("group", F.lit("unplaced"))
    return clustered.unionByName(unplaced)


def balanced_folds(sizes: dict[str, int], folds: int) -> dict[str, int]:
    """Largest group first into the lightest fold; ties by group name and fold number."""
    load = [0] * folds
    out = {}
    for group, size in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        lightest = load.index(min(load))
        out[group] = lightest
        load[lightest] += size
    return out


class Turns(NamedTuple):
    """Which folds groups of one size go to: from ``start`` on, in this order again and again."""

    start: int
    order: list[int]


def class_turns(load: list[int], size: int, count: int) -> list[Turns]:
    """Turns of ``count`` groups of one size, largest first into the lightest fold.

    ``load`` is brought up to date. There is a new entry only when another fold becomes as
    light as the others, so at most one per fold and one for the rest.
    """
    out, done, folds = [], 0, range(len(load))
    while done < count:
        lightest = min(folds, key=lambda k: (load[k], k))
        second = (load[lightest] + size, lightest)  # when the lightest has its next turn
        order = sorted((k for k in folds if (load[k], k) < second), key=lambda k: (load[k], k))
        rounds = (count - done) // len(order)
        for k in folds:
            if k not in order:  # rounds until this fold has a turn too
                ahead = load[k] - load[lightest] - (k < lightest)
                rounds = min(rounds, max(ahead // size, 1))
        out.append(Turns(done, order))
        if not rounds:
            for k in order[:count - done]:
                load[k] += size
            return out
        for k in order:
            load[k] += rounds * size
        done += rounds * len(order)
    return out


def _folds_of_groups(groups: DataFrame, group: str, folds: int) -> DataFrame:
    """``group`` and ``fold`` of a table of groups and their sizes ``n``, without listing them.

    The driver sees one count per size. Sizes add up to the rows, so there are at most about
    sqrt(2 rows) of them. Groups are sorted by size and name, and a group's turn is its place
    in that order less the place where its size begins.
    """
    spark = groups.sparkSession
    order = [F.desc("n"), F.col(group)]
    staged = stage_table(
        groups.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()), "groups")
    part = F.shiftright("_id", 33)
    starts, total = [], 0
    for r in sorted(staged.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect(), key=lambda r: r["p"]):
        starts.append((r["p"], total))
        total += r["c"]
    load, turns, before = [0] * folds, [], 0
    for r in staged.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():
        turns.append((r["n"], before, [tuple(t) for t in class_turns(load, r["n"], r["c"])]))
        before += r["c"]
    places = F.broadcast(spark.createDataFrame(starts, "_part long, _first long"))
    table = F.broadcast(spark.createDataFrame(
        turns, "n long, _before long, _turns array<struct<start: long, order: array<int>>>"))
    rank = F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("_before")
    turn = F.element_at(F.filter("_turns", lambda t: t["start"] <= F.col("_rank")), -1)
    return (
        staged.withColumn("_part", part).join(places, "_part").join(table, "n")
        .withColumn("_rank", rank).withColumn("_turn", turn)
        .select(group, F.get(
            "_turn.order", ((F.col("_rank") - F.col("_turn.start")) % F.size("_turn.order")).cast("int")).alias("fold"))
    )


def grouped_folds(
    df: DataFrame, group: str = "group", max_folds: int = MAX_FOLDS, listed: int = LISTED_GROUPS,
) -> DataFrame:
    """Add ``fold`` so that no group is split over folds: largest group first into the lightest.

    Up to ``listed`` groups are a literal; more are numbered and joined, with the same result.
    Rows without a group have no fold.
    """
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sizes = stage_table(sizes, "group-sizes")
    count = sizes.count()
    if count < 2:
        raise ValueError("grouped folds need at least two groups")
    folds = min(max_folds, count)
    if count > listed:
        return df.join(_folds_of_groups(sizes, group, folds), group, "left").select(*df.columns, "fold")
    found = balanced_folds({r[group]: r["n"] for r in sizes.collect()}, folds)
    table = F.create_map(*[x for g, f in found.items() for x in (F.lit(g), F.lit(f))])
    return df.withColumn("fold", F.try_element_at(table, F.col(group)))
