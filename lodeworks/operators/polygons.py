"""Point-in-polygon join on cells sized to each polygon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A layer of at most this many vertices is broadcast (about 16 bytes each);
# larger layers are spread over salts and shuffled by cell.
BROADCAST_VERTICES = 1_000_000
SALTS = 16
LAYER_WORDS = ["name", "unit", "lith", "type", "age"]
LAYER_COLUMNS = 4


def layer_attributes(columns: list[str]) -> list[str]:
    """Attribute columns worth joining: known words in the name, first four."""
    hits = [c for c in columns if any(w in c.lower() for w in LAYER_WORDS)]
    return hits[:LAYER_COLUMNS]


def box_ring(xmin, ymin, xmax, ymax) -> Column:
    """The four corners of a box as a ring."""
    def corner(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(
        corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax)
    )


def edges(rings: Column) -> Column:
    """Edges of all rings of a polygon, outer ring and holes alike."""
    def of_ring(ring):
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(ring, following, lambda a, b: F.struct(
            a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    return F.flatten(F.transform(rings, of_ring))


def inside(x: Column, y: Column, polygon_edges: Column) -> Column:
    """Even-odd test: a ray to the right crosses the edges an odd number of times."""
    def crossed(count, e):
        spans = (e["ay"] > y) != (e["by"] > y)
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
        return count + F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(polygon_edges, F.lit(0), crossed) % 2 == 1


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def join_polygons(
    points: DataFrame, layer: DataFrame, key: str, attributes: list[str],
    prefix: str = "geol_", salts: int = SALTS, broadcast_vertices: int = BROADCAST_VERTICES,
) -> DataFrame:
    """Left join of points (``key``, x, y) to the polygon that holds them.

    ``layer`` has poly_id, rings (arrays of x, y structs) and attribute columns.
    Each polygon is filed under cells at least as large as itself, so at most
    four per polygon; each point looks into one cell per polygon size in use.
    Where polygons overlap, the smallest poly_id wins. A hot cell's points are
    spread over salts before any shuffle.
    """
    xs = F.transform("edges", lambda e: e["ax"])
    ys = F.transform("edges", lambda e: e["ay"])
    boxed = layer.select("poly_id", edges(F.col("rings")).alias("edges"), *attributes).select(
        "*",
        F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
        F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"),
    )
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    level = F.ceil(F.log2(side)).cast("int")
    filed = boxed.withColumn("level", level)
    sizes = filed.groupBy("level").agg(F.sum(F.size("edges")).alias("vertices")).collect()
    levels = sorted(r["level"] for r in sizes)
    small = sum(r["vertices"] for r in sizes) <= broadcast_vertices
    cells = (
        filed.withColumn("cx", F.explode(F.sequence(
            _cell(F.col("x0"), F.col("level")), _cell(F.col("x1"), F.col("level")))))
        .withColumn("cy", F.explode(F.sequence(
            _cell(F.col("y0"), F.col("level")), _cell(F.col("y1"), F.col("level")))))
    )
    usable = points.select(key, "x", "y").filter("x IS NOT NULL AND y IS NOT NULL")
    probes = usable.withColumn(
        "level", F.explode(F.array(*[F.lit(v) for v in levels]) if levels
                           else F.array().cast("array<int>"))
    ).withColumns({
        "cx": _cell(F.col("x"), F.col("level")), "cy": _cell(F.col("y"), F.col("level")),
    })
    on = ["level", "cx", "cy"]
    if small:
        pairs = probes.join(F.broadcast(cells), on)
    else:
        spread = probes.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
        copies = F.array(*[F.lit(i) for i in range(salts)])
        pairs = spread.join(cells.withColumn("salt", F.explode(copies)), [*on, "salt"])
    boxed_in = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(
        F.col("y0"), F.col("y1"))
    found = (
        pairs.filter(boxed_in).filter(inside(F.col("x"), F.col("y"), F.col("edges")))
        .groupBy(key).agg(F.min(F.struct("poly_id", *attributes)).alias("_hit"))
        .select(
            key, F.col("_hit.poly_id").alias(f"{prefix}poly_id"),
            *[F.col(f"_hit.{a}").alias(f"{prefix}{a}") for a in attributes],
        )
    )
    return points.join(found, key, "left")
