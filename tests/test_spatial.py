"""Neighbours, polygons, rasters and grids against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions.geodesy import from_utm
from lodeworks.operators import grid, neighbours, placed, polygons, raster, skew
from lodeworks.session import stage_table


def brute(queries, sites, k):
    out = {}
    for q, x, y in queries:
        d = sorted((math.sqrt((sx - x) ** 2 + (sy - y) ** 2), s) for s, sx, sy in sites)
        out[q] = [s for _, s in d[:k]]
    return out


def skewed_sites(n):
    """A third on one spot, a third in a tiny cluster, the rest spread out."""
    rng = np.random.default_rng(11)
    spots = [(122.5, -28.5)] * (n // 3)
    spots += [tuple(122.6 + rng.normal(size=2) * 1e-7 - [0, 151]) for _ in range(n // 3)]
    spots += [(float(122 + rng.random()), float(-29 + rng.random())) for _ in range(n - len(spots))]
    return [(f"s{i:05d}", float(x), float(y)) for i, (x, y) in enumerate(spots)]


@pytest.mark.parametrize("k,n", [(1, 400), (8, 1500), (5, 3)])
def test_neighbours_equal_brute_force(spark, k, n):
    sites = skewed_sites(n)
    rng = np.random.default_rng(5)
    queries = [(f"q{i}", float(122 + rng.random()), float(-29 + rng.random()))
               for i in range(150)]
    queries += [(f"h{i}", x, y) for i, (_, x, y) in enumerate(sites[:: max(1, n // 40)])]
    queries += [("far", -170.0, 80.0), ("edge", 122.6, -28.4)]
    near = neighbours.nearest_sites(
        spark.createDataFrame(queries, "q string, x double, y double"),
        spark.createDataFrame(sites, "site_id string, x double, y double"), k, "q")
    found = {}
    for r in near.orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append(r["site_id"])
    assert found == brute(queries, sites, k)


def test_neighbours_below_broadcast_size(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BROADCAST_BOXES", 0)
    monkeypatch.setattr(neighbours, "SMALL_LEVEL", 0)
    monkeypatch.setattr(neighbours, "SITE_RUN", 4)
    sites = skewed_sites(600)
    queries = [(f"q{i}", x + 1e-3, y) for i, (_, x, y) in enumerate(sites[::9])]
    near = neighbours.nearest_sites(
        spark.createDataFrame(queries, "q string, x double, y double"),
        spark.createDataFrame(sites, "site_id string, x double, y double"), 8, "q")
    found = {}
    for r in near.orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append(r["site_id"])
    assert found == brute(queries, sites, 8)


@pytest.mark.parametrize("n", [64, 512, 4096])
def test_few_runs_of_sites_are_candidates_of_a_place(spark, n):
    """However rare places are among 200,000 sites, each looks into few runs."""
    k = 8
    place = [(F.rand(seed) - 0.5).alias(c) for seed, c in ((1, "x"), (2, "y"))]
    sites = stage_table(spark.range(200_000).select(F.col("id").cast("string").alias("site_id"), *place), "many")
    queries = spark.range(n).select(F.col("id").alias("q"), *[
        (F.rand(seed) - 0.5).alias(c) for seed, c in ((3, "x"), (4, "y"))])
    _, pairs = neighbours.candidates(stage_table(queries, "few"), sites, k)
    sizes = [r["n"] for r in pairs.groupBy("x", "y").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == n and np.mean(sizes) <= 3 * k and max(sizes) <= 10 * k


def test_hot_runs_and_places_without_coordinates(spark, monkeypatch):
    """Most places near one run of sites, many without a place, in salted joins."""
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    sites = skewed_sites(300)
    rng = np.random.default_rng(8)
    queries = [(f"q{i}", 122.5 + rng.random() * 1e-9, -28.5 + rng.random() * 1e-9) for i in range(400)]
    empty = [("n1", None, 1.0), ("n2", 1.0, None), ("n3", None, None), ("n4", float("nan"), 1.0)]
    places = spark.createDataFrame(queries + empty, "q string, x double, y double")
    points = spark.createDataFrame(sites, "site_id string, x double, y double").withColumn("v", F.lit(2.0))
    plain = skew.salted_join
    monkeypatch.setattr(neighbours, "salted_join", lambda *a: plain(*a, few_rows=50))
    found = {}
    for r in neighbours.nearest_sites(places, points, 3, "q").orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append(r["site_id"])
    assert found == brute(queries, sites, 3)
    rows = neighbours.idw(places, points, ["v"]).collect()
    assert len(rows) == 404
    assert {r["q"] for r in rows if r["idw_v"] is None} == {"n1", "n2", "n3", "n4"}
    none = neighbours.idw(places, points.limit(0), ["v"])
    assert none.count() == 404 and none.filter("idw_v IS NOT NULL").count() == 0
    assert neighbours.nearest_sites(places.limit(0), points, 3, "q").count() == 0


def test_salted_join_equals_a_plain_one(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 40).alias("k"), "id")
    right = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    left = left.withColumn("k", F.col("k").cast("int"))
    want = sorted(map(tuple, left.join(right, "k").select("k", "id", "v").collect()))
    got = skew.salted_join(left, right, "k", ["id"], few_rows=10)
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == want and "_salt" not in got.columns


def test_idw_on_a_labelled_point(spark):
    sites = spark.createDataFrame(
        [("a", 1.0, 1.0, 50.0), ("b", 1.1, 1.0, 90.0), ("c", 1.0, 1.2, None)],
        "site_id string, x double, y double, v double")
    places = spark.createDataFrame(
        [("p", 1.0, 1.0), ("none", None, None)], "id string, x double, y double")
    rows = {r["id"]: r for r in neighbours.idw(places, sites, ["v"]).collect()}
    assert rows["p"]["idw_v"] == pytest.approx(50.0, abs=1e-6)
    assert rows["p"]["idw_conf"] == pytest.approx(1.0, abs=1e-6)
    assert rows["none"]["idw_v"] is None


@pytest.mark.parametrize("limit", [10**6, 0])
def test_polygons_with_hole_and_concave_ring(spark, limit):
    ring = "array<array<struct<x:double,y:double>>>"
    concave = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]]
    holed = [[(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0)],
             [(14.0, 4.0), (16.0, 4.0), (16.0, 6.0), (14.0, 6.0)]]
    wide = [[(-100.0, -100.0), (100.0, -100.0), (100.0, 100.0), (-100.0, 100.0)]]
    layer = spark.createDataFrame(
        [(2, concave, "concave"), (3, holed, "holed"), (9, wide, "wide")],
        f"poly_id long, rings {ring}, unit string")
    points = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 15.0, 5.0), (4, 11.0, 5.0), (5, 200.0, 0.0),
         (6, None, 1.0)], "id long, x double, y double")
    joined = polygons.join_polygons(
        points, layer, "id", ["unit"], salts=3, broadcast_vertices=limit)
    assert {r["id"]: r["geol_unit"] for r in joined.collect()} == {
        1: "concave", 2: "wide", 3: "wide", 4: "holed", 5: None, 6: None}
    assert polygons.layer_attributes(["id", "UNITNAME", "lith1", "age_max", "type", "rocktype"]) \
        == ["UNITNAME", "lith1", "age_max", "type"]


def pixel_table(spark, array, raster_id="r"):
    rows = [(raster_id, i, j, float(v)) for i, row in enumerate(array) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "raster_id string, prow int, pcol int, val double")


def test_focal_statistics_equal_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 50, size=(7, 9)).astype(float)
    a[3, 3] = -9.0
    a[0, 0] = a[0, 1] = a[1, 0] = a[1, 1] = -9.0
    r = raster.Raster("r", 0.0, 7.0, 1.0, -1.0, nodata=-9.0)
    points = [(i * 9 + j, j + 0.5, 6.5 - i) for i in range(7) for j in range(9)]
    stats = raster.focal_statistics(
        spark.createDataFrame(points, "id long, x double, y double"), pixel_table(spark, a), [r])
    for row in stats.collect():
        i, j = divmod(row["id"], 9)
        window = a[max(i - 1, 0):i + 2, max(j - 1, 0):j + 2]
        valid = window[window != -9.0]
        expected = (valid.mean(), valid.std(), valid.max()) if valid.size else (0, 0, 0)
        assert (row["mean"], row["std"], row["max"]) == pytest.approx(expected)


def test_saturated_band_is_dropped_and_gaps_filled(spark):
    a = np.full((10, 10), 255.0)
    a[0, :5] = [1, 2, 3, 4, 5]
    r = raster.Raster("r", 0.0, 0.0, 1.0, 1.0)
    points = spark.createDataFrame(
        [(i * 10 + j, j + 0.5, i + 0.5) for i in range(10) for j in range(10)] + [(999, -5.0, 0.0)],
        "id long, x double, y double")
    samples = raster.sample_pixels(points, pixel_table(spark, a), [r])
    assert raster.saturated_rasters(samples) == ["r"]
    features = {x["id"]: x["r"] for x in raster.raster_features(
        points, samples, "id", [r]).collect()}
    assert features[0] == 1.0 and features[50] == 3.0 and features[999] == 3.0
    tiles = raster.tiles_from_pixels(pixel_table(spark, a), size=4)
    by_tile = {x["id"]: x["val"] for x in raster.sample_tiles(points, tiles, [r], size=4).collect()}
    assert by_tile == {x["id"]: x["val"] for x in samples.collect()}


def test_grid_size_and_bands(spark):
    collar = spark.createDataFrame(
        [(122.5, -28.9), (122.6, -28.8), (None, None)], "lon double, lat double")
    spec = grid.grid_spec(collar, 500.0)
    dlat = 500 / 111320
    assert spec.rows == len(np.arange(-28.9, -28.8 + dlat, dlat))
    assert grid.grid_points(spark, spec).count() == spec.rows * spec.cols
    bands = spark.createDataFrame([(0.39,), (0.4,), (0.85,), (0.7,)], "s double")
    assert [r[0] for r in bands.select(grid.band(F.col("s"))).collect()] == [0, 1, 4, 2]


def placed_points(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double").withColumns(
        {"raster_id": F.lit("clash"), "lon": F.lit(0.0), "zone": F.lit(1)}).drop("raster_id")


def by_hand(p, x, y):
    """Pixel below a place, through the full inverse."""
    col, row = np.linalg.solve([[p.xc, p.xr], [p.yc, p.yr]], [x - p.x0, y - p.y0])
    row, col = int(np.floor(row)), int(np.floor(col))
    return (row, col) if 0 <= row < p.rows and 0 <= col < p.cols else None


@pytest.mark.parametrize("limit", [10**6, 0])
def test_points_meet_rotated_and_turned_rasters(spark, limit):
    rng = np.random.default_rng(9)
    rasters = [
        placed.Placement("plain", 10.0, 50.0, 0.1, 0.0, 0.0, -0.1, 30, 20),
        placed.Placement("rotated", 11.0, 49.0, 0.07, 0.05, 0.04, -0.06, 25, 35, nodata=-1.0),
        placed.Placement("tiny", 11.0, 49.0, 1e-4, 0.0, 0.0, 1e-4, 3, 3),
        placed.Placement("turn", 350.0, 5.0, 1.0, 0.0, 0.0, -1.0, 10, 25),
        placed.Placement("none", 11.0, 49.0, 1.0, 0.0, 0.0, 1.0, 0, 5),
    ]
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(
        np.concatenate([rng.uniform([9, 46], [14, 51], (300, 2)), rng.uniform([-11, -6], [16, 6], (80, 2)),
                        [[11.00015, 49.00015], [10.0, 50.0]]]))]
    odd = [(900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 1.0), (903, 1.0, None)]
    want = set()
    for i, x, y in places:
        for p in rasters:
            for turn in (0.0, 360.0):
                at = by_hand(p, x + turn, y) if p.rows else None
                if at and (turn == 0.0 or p.raster_id == "turn"):
                    want.add((i, p.raster_id, *at))
    cat = placed.catalogue(placed.placements(spark, rasters))
    got = placed.meetings(placed_points(spark, places + odd), cat, limit)
    assert got.columns == ["id", "x", "y", "lon", "zone", "raster_id", "prow", "pcol", "nodata"]
    rows = [tuple(r) for r in got.select("id", "raster_id", "prow", "pcol").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {r[1] for r in rows} == {"plain", "rotated", "tiny", "turn"}
    assert placed.meetings(placed_points(spark, places), cat.limit(0)).count() == 0


def test_samples_and_windows_of_a_projected_raster(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 9, (40, 33)).astype(float)
    p = placed.Placement("utm", 450_000.0, 6_800_000.0, 120.0, 15.0, -20.0, -100.0, 40, 33, 0.0, 51, True)
    metres = spark.createDataFrame(
        [(i * 33 + j, p.x0 + (j + 0.5) * p.xc + (i + 0.5) * p.xr, p.y0 + (j + 0.5) * p.yc + (i + 0.5) * p.yr)
         for i in range(-1, 41) for j in range(33)], "id long, e double, n double")
    points = from_utm(metres, 51, True, x="e", y="n", lon="x", lat="y").select("id", "x", "y")
    tiles = raster.rim_tiles(pixel_table(spark, a, "utm"))
    cat = placed.catalogue(placed.placements(spark, [p]))
    got = {r["id"]: r["val"] for r in placed.sample_placed(points, tiles, cat).collect()}
    assert got == {i * 33 + j: a[i, j] or None for i in range(40) for j in range(33)}
    for r in placed.focal_placed(points, tiles, cat).collect():
        i, j = divmod(r["id"], 33)
        window = a[max(i - 1, 0):i + 2, max(j - 1, 0):j + 2]
        valid = window[window != 0.0]
        wanted = (valid.mean(), valid.std(), valid.max()) if valid.size else (0, 0, 0)
        assert (r["mean"], r["std"], r["max"]) == pytest.approx(wanted)


def test_pixels_are_shuffled_once_for_windows(spark):
    pixels = stage_table(pixel_table(spark, np.ones((20, 20))), "px")
    points = stage_table(spark.createDataFrame([(1, 3.0, 3.0)], "id long, x double, y double"), "pt")
    r = raster.Raster("r", 0.0, 0.0, 1.0, 1.0)
    stats = raster.focal_statistics(points, pixels, [r])
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(raster_id") <= 2  # one for pixels, one for points
    assert "Window" not in plan


@pytest.mark.parametrize("few", [0, 2000])
def test_tiles_are_joined_by_their_number_not_by_the_size_of_files(spark, monkeypatch, few):
    """Grouped pixels look as small as their file; only tiles below points are built."""
    monkeypatch.setattr(raster, "BROADCAST_TILES", few)
    pixels = stage_table(spark.range(64 * 64).selectExpr(
        "'a' AS raster_id", "CAST(id DIV 64 AS INT) AS prow", "CAST(id % 64 AS INT) AS pcol",
        "CAST(id AS DOUBLE) AS val"), "few-pixels")
    points = spark.createDataFrame(
        [("p", 1.5, -1.5), ("p", 1.5, -1.5), ("q", 63.5, -63.5), (None, 200.0, 1.0), ("n", None, 1.0)],
        "id string, x double, y double")
    cat = placed.catalogue(placed.placements(spark, [placed.Placement("a", 0.0, 0.0, 1.0, 0.0, 0.0, -1.0, 64, 64)]))
    found = placed.focal_placed(points, raster.rim_tiles(pixels), cat)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (few == 0) and "LeftSemi" in plan
    assert sorted((r["id"], r["mean"], r["max"]) for r in found.collect()) == [
        ("p", 65.0, 130.0), ("p", 65.0, 130.0), ("q", (4095 + 4094 + 4031 + 4030) / 4, 4095.0)]
    many = [raster.Raster("a", 0.0, 0.0, 1.0, -1.0)]
    assert sorted(((r["id"], r["max"]) for r in raster.focal_statistics(points, pixels, many).collect()), key=str) == [
        ("p", 130.0), ("p", 130.0), ("q", 4095.0), (None, 0.0)]
