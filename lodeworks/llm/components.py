"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.session import stage_table


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    ``links`` has two long columns, ``a`` and ``b``. Every node is tied to the smallest
    neighbour it knows of, alternately over all and over smaller neighbours, until nothing
    changes: rounds grow with the logarithm of the longest path, and each round is a grouped
    minimum and a join, so no neighbourhood is ever gathered. Rounds are staged, so a lost
    executor costs its tasks only. Null ends and self-links are left out.
    """
    edges = stage_table(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # what is not above any neighbour keeps its tie through its larger neighbours
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = stage_table(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
