"""A folder of mixed files, archives included, read and run end to end."""

import io
import json
import zipfile

import pytest

from lodeworks.jobs import main
from lodeworks.models import learners
from lodeworks.operators.files import files_by_role
from lodeworks.operators.places import in_degrees, looks_projected
from lodeworks.plans.intake import read_folder
from lodeworks.plans import prospect
from lodeworks.plans.prospect import run
from lodeworks.plans.surface import run_grid

LIGHT = {"rf": learners.Forest(trees=4, depth=3), "sgd": learners.RobustLinear(iterations=20)}


@pytest.fixture(scope="module")
def drop(tmp_path_factory):
    folder = tmp_path_factory.mktemp("mtpass_east")
    holes = [(f"H{i}", 122.5 + (i * 7 % 40) / 1000, -28.9 + (i * 11 % 40) / 1000)
             for i in range(40)]
    (folder / "dh_collar.csv").write_text(
        "CompanyHoleID,Longitude,Latitude,Elevation,Max Depth\n"
        + "".join(f" {h},{x},{y},{300 + i},{50 + i}\n" for i, (h, x, y) in enumerate(holes)))
    assay = "holeid,fromdepth,todepth,CeO2_ppm,Al2O3_ppm\n" + "".join(
        f"{h},{d},{d + 10},{100 * i + d},{7}\n" for i, (h, _, _) in enumerate(holes[:30])
        for d in (0, 10, 20))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("tables/dh_assay_pivoted.csv", assay)
    (folder / "bundle.zip").write_bytes(packed.getvalue())
    (folder / "dh_alteration.csv").write_bytes(
        "collarid,attributevalue\nH1,Argile lat\xe9ritique Laterite\nH1,clay\nH9,CLAY\n"
        .encode("latin1"))
    rows = "\n".join(" ".join(str(r * 8 + c) for c in range(8)) for r in range(8))
    (folder / "dem_10m.asc").write_text(
        "ncols 8\nnrows 8\nxllcorner 122.49\nyllcorner -28.91\ncellsize 0.01\n"
        f"nodata_value -9999\n{rows}\n")
    return folder


def test_folder_to_targets(spark, drop, tmp_path):
    intake = read_folder(spark, str(drop))
    layers = {r["name"]: r["layer"] for r in intake.files.collect()}
    assert layers["dem_10m.asc"] == "topography" and layers["bundle.zip"] == "archive"
    assert intake.inputs.collar.count() == 40
    assert intake.inputs.assay.count() == 90
    assert "lu2o3_ppm" not in intake.inputs.assay.columns
    result = run(spark, intake.inputs, intake.deposit, str(tmp_path), learners=LIGHT)
    assert result.status == "success" and result.labelled == 30
    rows = {r["hole_id"]: r for r in result.scored.collect()}
    assert rows["H1"]["is_laterit"] == 1 and rows["H1"]["is_clay"] == 1
    assert rows["H9"]["is_clay"] == 1 and rows["H2"]["is_clay"] == 0
    assert rows["H3"]["treo_max"] == 320.0 and rows["H35"]["treo_max"] is None
    assert rows["H0"]["r_dem_10m_mean"] is not None and rows["H35"]["pseudo_treo"] > 0
    assert all(0 <= r["score_100"] <= 100 for r in rows.values())


def test_long_assay_is_pivoted(spark, tmp_path):
    (tmp_path / "dh_collar.csv").write_text("holeid,easting,northing\nA,1,2\n")
    (tmp_path / "dh_assay.csv").write_text(
        "holeid,attributecolumn,attributevalue\nA,CeO2,9\nA,CeO2,10\nA,La2O3,x\n")
    intake = read_folder(spark, str(tmp_path))
    row = intake.inputs.assay.first()
    assert row["ceo2_ppm"] == 10.0 and row["la2o3_ppm"] is None


def test_projected_coordinates_need_a_zone(spark):
    df = spark.createDataFrame([(455000.0, 6807000.0)], "lon double, lat double")
    assert looks_projected(df)
    with pytest.raises(ValueError):
        in_degrees(df, None, None)
    row = in_degrees(df, 51, True).first()
    assert 122 < row["lon"] < 123 and -29 < row["lat"] < -28


def test_inventory_command(spark, drop, tmp_path, capsys):
    main(["inventory", str(drop), "--root", str(tmp_path)])
    assert "drillhole" in capsys.readouterr().out


@pytest.fixture(scope="module")
def wide_drop(tmp_path_factory):
    """Two collars, two assays, a grid in UTM metres and two polygon layers."""
    folder = tmp_path_factory.mktemp("mtwide_west")
    holes = [(f"H{i}", 450_000.0 + (i * 7 % 40) * 100, 6_800_000.0 + (i * 11 % 40) * 100) for i in range(40)]
    for part, rows in (("a", holes[:25]), ("b", [("H3", *holes[3][1:]), *holes[25:]])):
        (folder / f"dh_collar_{part}.csv").write_text(
            "holeid,easting,northing,elevation\n" + "".join(
                f"{h},{x},{y},{100 if part == 'a' else 200}\n" for h, x, y in rows))
    for part, rows in (("1", holes[:20]), ("2", holes[20:32])):
        (folder / f"dh_assay_{part}.csv").write_text(
            "holeid,fromdepth,todepth,CeO2_ppm\n" + "".join(
                f"{h},{d},{d + 10},{100 * int(h[1:]) + d}\n" for h, _, _ in rows for d in (0, 10)))
    values = "\n".join(" ".join(str(r * 50 + c) for c in range(50)) for r in range(50))
    (folder / "mag_grid.asc").write_text(
        f"ncols 50\nnrows 50\nxllcorner 449950\nyllcorner 6799950\ncellsize 100\nnodata_value -9999\n{values}\n")
    for name, low, high in (("shale", 119, 122.5), ("iron stone!", 122.5, 125)):
        ring = [[low, -30], [high, -30], [high, -28], [low, -28], [low, -30]]
        (folder / f"{name.split()[0]}.geojson").write_text(json.dumps({
            "type": "FeatureCollection", "features": [{
                "type": "Feature", "properties": {"unit_name": name, "other": 1},
                "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    return folder


def test_all_files_of_a_role_projected_grids_and_layers_are_used(spark, wide_drop, tmp_path):
    with pytest.raises(ValueError):
        read_folder(spark, str(wide_drop))
    intake = read_folder(spark, str(wide_drop), zone=51, south=True)
    collar = {r["hole_id"]: r for r in intake.inputs.collar.collect()}
    assert len(collar) == 40 == intake.inputs.collar.count()
    assert collar["H3"]["elevation"] == 200 and collar["H4"]["elevation"] == 100
    assert intake.inputs.assay.count() == 64 and len(intake.polygon_files) == 2
    result = run(spark, intake.inputs, intake.deposit, str(tmp_path), learners=LIGHT)
    assert result.status == "success" and result.labelled == 32
    rows = {r["hole_id"]: r for r in result.scored.collect()}
    for h, r in rows.items():  # the pixel whose corner is 50 m off, and its eight neighbours
        i = int(h[1:])
        col, row = i * 7 % 40, 49 - i * 11 % 40
        around = [a * 50 + b for a in range(max(row - 1, 0), min(row + 2, 50)) for b in range(max(col - 1, 0), col + 2)]
        assert r["r_mag_grid_max"] == max(around)
        assert r["r_mag_grid_mean"] == pytest.approx(sum(around) / len(around))
    assert {r["geol_unit_name_shale"] for r in rows.values()} == {0, 1}
    assert any(f.startswith("geol_unit_name_") for f in result.features)
    version = result.bundle.info["version"]
    table = spark.read.option("header", True).csv(f"{tmp_path}/scored_csv/{intake.deposit}/{version}")
    assert table.count() == 40 and "score_100" in table.columns
    lines = spark.read.text(f"{tmp_path}/scored_geojson/{intake.deposit}/{version}").collect()
    assert len(lines) == 40 and json.loads(lines[0][0])["geometry"]["type"] == "Point"


def test_grid_is_scored_on_the_features_of_holes(spark, wide_drop, tmp_path):
    intake = read_folder(spark, str(wide_drop), zone=51, south=True)
    result = run_grid(spark, intake.inputs, intake.deposit, str(tmp_path), 200.0, {
        "rf": learners.Forest(trees=4, depth=3), "gb": learners.Boosted(rounds=2)})
    assert result.status == "success"
    assert {"r_mag_grid_mean", "coord_lon_norm", "dist_centroid", "geol_unit_name_shale"} <= set(result.features)
    rows = result.scored.collect()
    assert len(rows) == len({(r["grow"], r["gcol"]) for r in rows}) > 300
    assert all(0 <= r["prospectivity"] <= 1 for r in rows)
    assert sum(r["cells"] for r in result.bands.collect()) == len(rows)
    csv = spark.read.option("header", True).csv(f"{tmp_path}/grid_csv/{intake.deposit}")
    assert csv.count() == len(rows)
    # a place has the features of a hole at that place
    master = prospect.hole_features(intake.inputs)
    hole = master.filter("hole_id = 'H5'").first()
    point = spark.createDataFrame([(1, hole["lon"], hole["lat"])], "cell_id long, x double, y double")
    window = prospect.raster_windows(point, intake.inputs, "cell_id").first()
    assert [window[f"r_mag_grid_{s}"] for s in ("mean", "std", "max")] == [
        hole[f"r_mag_grid_{s}"] for s in ("mean", "std", "max")]
    assert run_grid(spark, type(intake.inputs)(intake.inputs.collar), "x", str(tmp_path)).status == "insufficient_data"


def test_files_by_role(spark):
    def roles(*names):
        rows = [(n, i, "d") for i, n in enumerate(names)]
        found = files_by_role(spark.createDataFrame(rows, "path string, ordinal int, deposit string"), "deposit")
        return sorted((r["role"], r["path"]) for r in found.collect())

    assert roles("collar1.csv", "x.csv", "collar2.csv", "assay.csv", "assay2.csv") == [
        ("assay", "assay.csv"), ("assay", "assay2.csv"), ("collar", "collar1.csv"), ("collar", "collar2.csv")]
    assert roles("collar.csv", "assay.csv", "assay_pivot.csv", "my_pivot.csv", "geochem.csv") == [
        ("assay", "assay_pivot.csv"), ("assay", "my_pivot.csv"), ("collar", "collar.csv"), ("geochem", "geochem.csv")]
    assert roles("a.csv", "b.csv", "c.csv", "d.csv") == [
        ("alteration", "c.csv"), ("assay", "b.csv"), ("collar", "a.csv")]
