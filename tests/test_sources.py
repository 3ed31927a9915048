"""Readers, archives, text rasters, polygon layers and sinks on small files."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeworks.functions.naming import hole_key_column, oxide_sources
from lodeworks.operators.files import classified, header_columns, json_shape
from lodeworks.operators.holes import typed_assay
from lodeworks.sources import archives, delimited, grids, listing, sinks, vectors
from lodeworks.sources.archives import member_table


def test_listing_and_inventory(spark, tmp_path):
    (tmp_path / "depA").mkdir()
    (tmp_path / "depA" / "dh Collar.CSV").write_text("HoleID,x\n1,2\n")
    (tmp_path / "notes.txt").write_text("hello")
    rows = {r["name"]: r for r in listing.inventory(spark, str(tmp_path)).collect()}
    assert rows["dh Collar.CSV"]["ext"] == ".csv"
    assert rows["dh Collar.CSV"]["stem"] == "dh_collar"
    assert rows["dh Collar.CSV"]["folder"] == "depA"
    assert rows["notes.txt"]["length"] == 5


def test_csv_encodings_and_headers(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("HoleID,Company\nA1,Société\n".encode())
    (tmp_path / "l.csv").write_bytes("HoleID,Company\nB1,Société\n".encode("latin1"))
    (tmp_path / "o.csv").write_bytes(b"Company,HoleID,CeO2 ppm\nX,C1,12.5\n")
    paths = [str(p) for p in tmp_path.iterdir()]
    described = {r["path"][-5:]: r for r in delimited.describe_text_files(spark, paths).collect()}
    assert described["u.csv"]["is_utf8"] and not described["l.csv"]["is_utf8"]
    assert described["o.csv"]["header"] == "Company,HoleID,CeO2 ppm"
    table = delimited.read_csv(spark, paths)
    rows = {r["holeid"]: r for r in table.collect()}
    assert rows["A1"]["company"] == rows["B1"]["company"] == "Société"
    assert rows["C1"]["ceo2_ppm"] == "12.5" and rows["C1"]["company"] == "X"
    report = delimited.header_report(delimited.describe_text_files(spark, paths))
    flagged = {r["path"][-5:]: r["rare_earth_columns"] for r in report.collect()}
    assert flagged["o.csv"] == ["ceo2 ppm"]


def test_assay_typing_keeps_alumina_out(spark):
    raw = spark.createDataFrame(
        [(" h1 ", "5", "7", "9", "x")],
        ["holeid", "al2o3_ppm", "la2o3_ppm", "fe2o3_ppm", "ceo2_pct"])
    typed = typed_assay(raw, hole_key_column(raw.columns), oxide_sources(raw.columns))
    row = typed.first()
    assert row["hole_id"] == "h1" and row["la2o3_ppm"] == 7.0 and row["ceo2_ppm"] is None
    assert "lu2o3_ppm" not in typed.columns and row["al2o3_ppm"] == 5.0


def make_zip(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


def test_archives_are_expanded(spark, tmp_path):
    inner = make_zip({"deep/b.csv": b"HoleID,v\nh2,3\n"})
    (tmp_path / "a.zip").write_bytes(make_zip(
        {"a.csv": b"HoleID,v\nh1,2\n", "inner.zip": inner, "../x": b"bad"}))
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("c.csv")
        info.size = 15
        t.addfile(info, io.BytesIO(b"HoleID,v\nh3,4\n\n"))
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    members = archives.expand_archives(spark, [str(tmp_path)])
    rows = members.collect()
    good = {r["member"]: bytes(r["content"]) for r in rows if r["problem"] is None}
    assert good["a.csv"].startswith(b"HoleID") and good["c.csv"].startswith(b"HoleID")
    assert good["inner.zip!deep/b.csv"] == b"HoleID,v\nh2,3\n"
    bad = {r["member"]: r["problem"] for r in rows if r["problem"]}
    assert bad["../x"] == "unsafe member name"
    assert any(name.endswith("broken.zip") for name in bad)
    table = member_table(members.filter("member LIKE '%.csv'"))
    assert {(r["holeid"], r["v"]) for r in table.collect()} == {
        ("h1", "2"), ("h2", "3"), ("h3", "4")}


def test_ascii_grid(spark, tmp_path):
    text = ("ncols 5\nnrows 4\nxllcorner 100\nyllcorner 10\ncellsize 2\nNODATA_value -9\n"
            + "\n".join(" ".join(str(r * 5 + c) for c in range(5)) for r in range(4)) + "\n")
    path = tmp_path / "dem.asc"
    path.write_text(text.replace(" 7 ", " -9 "))
    pixels, rasters = grids.read_asc(spark, [str(path)])
    assert rasters == [grids.Raster("dem", 100.0, 18.0, 2.0, -2.0, -9.0, 4, 5)]
    values = {(r["prow"], r["pcol"]): r["val"] for r in pixels.collect()}
    assert len(values) == 20 and values[(3, 4)] == 19.0 and values[(1, 2)] == -9.0
    (tmp_path / "p.xyz").write_text("100.5 17.5 3.5\n103,11,4\n")
    xyz = grids.read_xyz(spark, [str(tmp_path / "p.xyz")], rasters[0]).collect()
    assert {(r["prow"], r["pcol"], r["val"]) for r in xyz} == {(0, 0, 3.5), (3, 1, 4.0)}


def test_ascii_grids_by_centre_with_wrapped_rows_and_one_name(spark, tmp_path):
    head = "NCOLS 4\nNROWS 2\nXLLCENTER 101\nYLLCENTER 11\nCELLSIZE 2\n"
    for folder, shift in (("a", 0), ("b", 100)):
        (tmp_path / folder).mkdir()
        values = [str(shift + v) for v in range(8)]
        (tmp_path / folder / "dem.asc").write_text(
            head + "\n".join((" ".join(values[:3]), " ".join(values[3:6]), " ".join(values[6:]))))
    pixels, rasters = grids.read_asc(
        spark, [str(tmp_path / f / "dem.asc") for f in ("b", "a")])
    assert rasters == [grids.Raster(name, 100.0, 14.0, 2.0, -2.0, None, 2, 4)
                       for name in ("dem", "dem~2")]
    values = {(r["raster_id"], r["prow"], r["pcol"]): r["val"] for r in pixels.collect()}
    assert values == {(name, v // 4, v % 4): float(shift + v)
                      for name, shift in (("dem", 0), ("dem~2", 100)) for v in range(8)}


def test_geojson_polygons(spark, tmp_path):
    def polygon(rings, kind="Polygon", **props):
        return {"type": "Feature", "properties": props,
                "geometry": {"type": kind, "coordinates": rings}}

    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    far = [[[9, 9], [10, 9], [10, 10], [9, 10], [9, 9]]]
    features = [polygon(square, name="sq"), polygon([square, far], "MultiPolygon", name="multi")]
    (tmp_path / "g.geojson").write_text(
        json.dumps({"type": "FeatureCollection", "features": features}))
    layer = vectors.read_polygons(spark, [str(tmp_path / "g.geojson")], ["name"])
    rows = layer.orderBy("poly_id").collect()
    assert [(r["poly_id"], r["name"]) for r in rows] == [(0, "sq"), (1, "multi"), (1, "multi")]
    assert rows[0]["rings"][0][2] == (4.0, 4.0)
    (tmp_path / "lines.geojsonl").write_text("\n".join(json.dumps(f) for f in features))
    by_line = vectors.read_polygons(
        spark, [str(tmp_path / "lines.geojsonl")], ["name"], by_line=True)
    assert by_line.count() == 3


def test_geojson_sink(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", 1.5, 2.5, None, 9.0), ("b", None, 2.0, 1.0, 8.0)],
        "hole_id string, lon double, lat double, treo double, score double")
    sinks.write_geojson_lines(df, str(tmp_path / "out"))
    rows = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert rows == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]},
                     "properties": {"hole_id": "a", "treo": None, "score": 9.0}}]
    doc = json.loads(sinks.feature_collection(df, 5, "score", "hole_id"))
    assert doc["type"] == "FeatureCollection" and len(doc["features"]) == 1


def test_header_and_json_shapes(spark):
    df = spark.createDataFrame([(' "Hole ID" , CeO2,x\t',)], "h string")
    assert df.select(header_columns(F.col("h")).alias("c")).first()["c"] == [
        "hole id", "ceo2", "x"]
    texts = [('{"a":1,"b":2}', "object:a,b"), ('[{"k":1},{"k":2}]', "list[2]:k"),
             ("[1,2,3]", "list[3]:scalar"), ("[]", None), ("oops", None)]
    df = spark.createDataFrame(texts, "t string, e string")
    for row in df.select("e", json_shape(F.col("t")).alias("s")).collect():
        assert row["e"] == row["s"]


@pytest.mark.parametrize("name,header,layer", [
    ("dh_collar.csv", "HoleID,Easting", "drillhole"),
    ("tmi_grid.tif", None, "geophysics"),
    ("landsat_B4.tif", None, "satellite"),
    ("geology_units.geojson", None, "geology"),
    ("dem_10m.asc", None, "topography"),
    ("data.zip", None, "archive"),
    ("soil_lines.txt", "Au,Cu,lab,units", "geochemical"),
])
def test_layers(spark, name, header, layer):
    df = spark.createDataFrame([(f"/d/x/{name}", header)], "path string, header string")
    row = classified(df).first()
    assert row["layer"] == layer and 0 < row["confidence"] <= 1 and row["reasons"]
