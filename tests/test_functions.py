"""Column expressions and name resolution on hand-computed values."""

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import naming
from lodeworks.functions.geochem import depth_score, interval_columns, label_scale
from lodeworks.functions.geodesy import from_utm, to_utm
from lodeworks.functions.numeric import byte_size, finite_or_zero, half_even, to_number
from lodeworks.functions.spectral import spectral_indices


def values(df, column):
    return [r[column] for r in df.select(column).collect()]


def test_to_number(spark):
    texts = ["1.5", " 1.5 ", "1,5", "<0.5", "1d", "NaN", "-2e3", ".5", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df.select(to_number(F.col("t")).alias("n")), "n") == [
        1.5, 1.5, None, None, None, None, -2000.0, 0.5, None, None]


def test_depth_ladder_edges(spark):
    depths = [None, 19.9, 20.0, 50.0, 100.0, 200.0]
    df = spark.createDataFrame([(d,) for d in depths], "d double")
    assert values(df.select(depth_score(F.col("d")).alias("s")), "s") == [
        0.5, 1.0, 0.95, 0.85, 0.65, 0.35]
    assert values(df.select(depth_score(F.col("d"), "matrix").alias("s")), "s") == [
        0.5, 1.0, 0.95, 0.85, 0.65, 0.45]


def test_score_rounds_half_to_even(spark):
    df = spark.createDataFrame([(62.25,), (62.35,)], "s double")
    assert values(df.select(half_even(F.col("s"), 1).alias("r")), "r")[0] == 62.2


def test_all_null_interval(spark):
    df = spark.createDataFrame(
        [(None, None), (2.0, None)], "ceo2_ppm double, dy2o3_ppm double")
    rows = df.withColumns(interval_columns(df.columns)).orderBy("treo").collect()
    assert rows[0]["treo"] is None and rows[0]["lree"] == 0.0 and rows[0]["hree"] == 0.0
    assert rows[0]["lree_hree_ratio"] == 0.0
    assert rows[1]["treo"] == 2.0 and rows[1]["lree_hree_ratio"] == pytest.approx(2000.0)


def test_element_columns_used_without_oxides():
    made = interval_columns(["ce_ppm", "la_ppm", "gd_ppm", "fromdepth"])
    assert set(made) == {"treo", "lree", "hree", "lree_hree_ratio"}


def test_label_scale_fallbacks():
    assert label_scale(7.0, 5) == 1000.0
    assert label_scale(0.0, 50) == 1.0
    assert label_scale(7.0, 50) == 7.0


def test_not_finite_becomes_zero(spark):
    df = spark.createDataFrame(
        [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (3.0,)], "v double")
    assert values(df.select(finite_or_zero(F.col("v")).alias("z")), "z") == [0, 0, 0, 0, 3.0]


def test_byte_size(spark):
    df = spark.createDataFrame([(512,), (1536,), (3 * 1024**3,), (2 * 1024**4,)], "b long")
    assert values(df.select(byte_size(F.col("b")).alias("s")), "s") == [
        "512.0 B", "1.5 KB", "3.0 GB", "2.0 TB"]


def test_spectral_zero_denominator(spark):
    df = spark.createDataFrame([(0.0, 4.0, 2.0)], "blue double, red double, nir double")
    bands = {b: F.col(b) for b in df.columns}
    row = df.select(*[c.alias(n) for n, c in spectral_indices(bands).items()]).first()
    assert row["si_iron_oxide"] == 0.0
    assert row["si_ndvi"] == pytest.approx(-2 / 6)
    assert "si_clay_index" not in row.asDict()


def test_utm_there_and_back(spark):
    rows = [(122.54, -28.86), (120.1, -5.0), (125.9, -60.0), (123.0, -1e-6)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    back = from_utm(to_utm(df, 51, south=True), 51, south=True, lon="lon2", lat="lat2")
    for r in back.collect():
        assert r["lon2"] == pytest.approx(r["lon"], abs=2e-8)
        assert r["lat2"] == pytest.approx(r["lat"], abs=2e-8)
    first = to_utm(df.limit(1), 51, south=True).first()
    assert first["x"] == pytest.approx(455133, abs=150) and 6.8e6 < first["y"] < 6.82e6
    with pytest.raises(ValueError):
        to_utm(df, 0, south=True)


def test_oxide_matching_keeps_to_the_element():
    assert naming.match_oxide("CeO2_ppm") == "ceo2"
    for other in ("al2o3", "fe2o3", "cr2o3", "sc2o3", "b2o3", "sio2"):
        assert naming.match_oxide(other) is None, other
    assert naming.oxide_sources(["al2o3_ppm", "la2o3_ppm", "fe2o3_ppm"]) == {
        "la2o3_ppm": "la2o3_ppm"}
    assert naming.oxide_sources(["ce_o2_ppm", "ceo2_ppm"])["ceo2_ppm"] == "ceo2_ppm"


def test_schema_resolution():
    names = naming.standard_names([" HoleID", "Max Depth", "holeid"])
    assert names == ["holeid", "max_depth", "holeid_2"]
    assert naming.hole_id_column(["x", "holeid", "companyholeid"]) == "companyholeid"
    assert naming.hole_id_column(["site", "x"]) == "site"
    found = naming.coordinate_columns(["easting", "northing", "lat"])
    assert found == {"lat": "lat", "lon": None, "easting": "easting", "northing": "northing"}


def test_path_parts(spark):
    df = spark.createDataFrame([("/d/Mount Weld/LC09.B4.TIF",), ("/d/x/readme",)], "p string")
    p = F.col("p")
    rows = df.select(
        naming.file_stem(p).alias("s"), naming.file_extension(p).alias("e"),
        naming.folder_name(p).alias("f")).collect()
    assert tuple(rows[0]) == ("LC09.B4", ".tif", "Mount Weld")
    assert tuple(rows[1]) == ("readme", "", "x")
