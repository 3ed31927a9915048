"""Queries over places: projection, neighbours, polygons, rasters and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.checks.holes import HOLE, TOTALS, hole_table
from lodeworks.checks.registry import over, query, r, rounded, settled
from lodeworks.functions.geodesy import (
    BACKWARD, CONFORMAL, FORWARD, LATITUDE, RECTIFYING, from_utm, to_utm,
)
from lodeworks.functions.spectral import spectral_indices
from lodeworks.operators import grid, neighbours, placed, polygons, raster
from lodeworks.operators.places import in_degrees
from lodeworks.operators.raster import rim_tiles
from lodeworks.plans.holes import geology_matrix as geology_features
from lodeworks.plans.surface import grid_features
from lodeworks.session import stage_table
from lodeworks.sources.tables import view

ZONE = 51
MAGNETIC = raster.Raster(
    "tmi", x0=122.5, y0=-28.8, dx=0.0025, dy=-0.002, nodata=-9999.0, rows=50, cols=40
)
FLIPPED = raster.Raster("tmi_south", x0=122.5, y0=-28.9, dx=0.0025, dy=0.002, nodata=-9999.0)

_FORWARD_STEPS = {
    "t": f"""SELECT *, sinh(atanh(sin(radians(lat)))
      - {CONFORMAL!r}*atanh({CONFORMAL!r}*sin(radians(lat)))) AS t,
      radians(lon - {6 * ZONE - 183}) AS dl FROM collar""",
    "s": """SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl)/sqrt(1+t*t)) AS eta FROM t""",
    "u": f"""SELECT *, 500000 + {RECTIFYING!r}*(eta + """ + " + ".join(
        f"{a!r}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(FORWARD, 1))
    + f""") AS x, 10000000 + {RECTIFYING!r}*(xi + """ + " + ".join(
        f"{a!r}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(FORWARD, 1))
    + ") AS y FROM s",
}
_BACKWARD_STEPS = {
    "b": f"""SELECT hole_id, x, y, (y-10000000)/{RECTIFYING!r} AS xi,
      (x-500000)/{RECTIFYING!r} AS eta FROM (SELECT hole_id, 450000e0 + elevation*3 AS x,
      6800000e0 + maxdepth*7 AS y FROM collar)""",
    "b1": "SELECT *, xi - (" + " + ".join(
        f"{a!r}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(BACKWARD, 1))
    + ") AS xi1, eta - (" + " + ".join(
        f"{a!r}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(BACKWARD, 1))
    + ") AS eta1 FROM b",
    "b2": "SELECT *, asin(sin(xi1)/cosh(eta1)) AS chi FROM b1",
}


@query(over(
    ["collar"],
    f"SELECT hole_id, {r('x', 3)} AS x, {r('y', 3)} AS y FROM u", **_FORWARD_STEPS,
))
def utm_forward(spark, sf):
    placed = to_utm(view(spark, sf, "collar"), ZONE, south=True)
    return settled(placed.select("hole_id", "x", "y"), 3)


@query(over(
    ["collar"],
    f"""SELECT hole_id, {r('degrees(chi + ' + ' + '.join(
        f'({d!r})*sin({2 * j}*chi)' for j, d in enumerate(LATITUDE, 1)) + ')', 7)} AS lat,
      {r(f'{6 * ZONE - 183} + degrees(atan2(sinh(eta1), cos(xi1)))', 7)} AS lon FROM b2""",
    **_BACKWARD_STEPS,
))
def utm_inverse(spark, sf):
    metres = view(spark, sf, "collar").select(
        "hole_id", (F.lit(450000.0) + F.col("elevation") * 3).alias("x"),
        (F.lit(6800000.0) + F.col("maxdepth") * 7).alias("y"),
    )
    return settled(from_utm(metres, ZONE, south=True).select("hole_id", "lat", "lon"), 7)


def _sites(spark, sf, values=("treo_max",)):
    holes = hole_table(spark, sf).filter("treo_max IS NOT NULL")
    return stage_table(holes.select(
        F.col("hole_id").alias("site_id"), F.col("lon").alias("x"), F.col("lat").alias("y"),
        *values,
    ), "sites-in")


def _places(spark, sf):
    return view(spark, sf, "collar").select(
        "hole_id", F.col("lon").alias("x"), F.col("lat").alias("y"))


_NEAR = {
    "totals": TOTALS,
    "hole": HOLE,
    "pairs": """SELECT q.hole_id, s.hole_id AS site_id, s.treo_max,
      sqrt((s.lon-q.lon)*(s.lon-q.lon)+(s.lat-q.lat)*(s.lat-q.lat)) AS d
      FROM hole q JOIN hole s ON s.treo_max IS NOT NULL AND s.lon IS NOT NULL
      WHERE q.lon IS NOT NULL""",
    "ranked": """SELECT *, CAST(row_number() OVER
      (PARTITION BY hole_id ORDER BY d, site_id) AS INT) AS rank FROM pairs""",
}


@query(over(
    ["collar", "assay"],
    f"SELECT hole_id, rank, site_id, {r('d', 6)} AS d FROM ranked WHERE rank <= 8", **_NEAR,
))
def nearest_neighbours(spark, sf):
    near = neighbours.nearest_sites(_places(spark, sf), _sites(spark, sf), 8, "hole_id")
    return settled(near, 6)


@query(over(
    ["collar", "assay"],
    f"SELECT hole_id, site_id, {r('d*111320')} AS nearest_m FROM ranked WHERE rank = 1", **_NEAR,
))
def nearest_hole(spark, sf):
    near = neighbours.nearest_sites(_places(spark, sf), _sites(spark, sf), 1, "hole_id")
    return near.select(
        "hole_id", "site_id", rounded(F.col("d") * 111320.0).alias("nearest_m"))


@query(over(
    ["collar", "assay"],
    f"""SELECT hole_id, {r('sum(w*treo_max)/sum(w)', 3)} AS pseudo_treo,
      {r('1/(1+greatest(min(d)*111320,1e-6)/100)', 6)} AS idw_conf
    FROM (SELECT *, 1/pow(greatest(d*111320,1e-6),2) AS w FROM ranked WHERE rank <= 8)
    GROUP BY hole_id UNION ALL
    SELECT hole_id, NULL, NULL FROM collar WHERE lon IS NULL""", **_NEAR,
))
def idw_estimates(spark, sf):
    out = neighbours.idw(_places(spark, sf), _sites(spark, sf), ["treo_max"], prefix="pseudo_")
    return out.select(
        "hole_id", rounded(F.col("pseudo_treo_max"), 3).alias("pseudo_treo"),
        rounded(F.col("idw_conf"), 6).alias("idw_conf"),
    )


def _layer(spark, sf):
    boxes = view(spark, sf, "polygons")
    ring = polygons.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return boxes.select("poly_id", "unit_name", F.array(ring).alias("rings"))


@query(over(
    ["collar", "polygons"],
    """SELECT c.hole_id, min(p.poly_id) AS geol_poly_id,
      min_by(p.unit_name, p.poly_id) AS geol_unit_name
    FROM collar c LEFT JOIN polygons p ON lon >= xmin AND lon < xmax
      AND lat >= ymin AND lat < ymax GROUP BY c.hole_id""",
))
def polygon_join(spark, sf):
    layer = _layer(spark, sf)
    names = polygons.layer_attributes(["unit_name"])
    return polygons.join_polygons(_places(spark, sf), layer, "hole_id", names).drop("x", "y")


@query(over(
    ["collar", "assay", "alteration", "polygons"],
    f"""SELECT hole_id, deposit, {r("coalesce(alt_clay, m_clay, 0e0)")} AS alt_clay,
      {r("coalesce(alt_weath, m_weath, 0e0)")} AS alt_weath,
      {r("coalesce(elevation, m_elev, 0e0)")} AS elevation,
      CASE WHEN fromdepth_min IS NULL THEN 0.5e0 WHEN fromdepth_min<20 THEN 1e0
        WHEN fromdepth_min<50 THEN 0.95e0 WHEN fromdepth_min<80 THEN 0.85e0
        WHEN fromdepth_min<150 THEN 0.65e0 WHEN fromdepth_min<300 THEN 0.45e0 ELSE 0.25e0 END
        AS depth_score,
      {r("coalesce(least(greatest(treo_max/p95,0e0),1e0),0e0)", 6)} AS treo_norm,
      CASE WHEN unit = 'NATION_12' THEN 1e0 ELSE 0e0 END AS geol_unit_name_NATION_12,
      CASE WHEN unit IS NULL THEN 1e0 ELSE 0e0 END AS geol_unit_name_unknown
    FROM m LEFT JOIN alt USING (hole_id) LEFT JOIN geo USING (hole_id) CROSS JOIN s""",
    totals=TOTALS, m=HOLE,
    alt="""SELECT hole_id,
      max(CASE WHEN lower(attributevalue) LIKE '%clay%' THEN 1e0 ELSE 0e0 END) AS alt_clay,
      max(CASE WHEN lower(attributevalue) LIKE '%weath%' THEN 1e0 ELSE 0e0 END) AS alt_weath
      FROM alteration GROUP BY hole_id""",
    geo="""SELECT c.hole_id, min_by(p.unit_name, p.poly_id) AS unit FROM collar c JOIN polygons p
      ON lon >= xmin AND lon < xmax AND lat >= ymin AND lat < ymax GROUP BY c.hole_id""",
    s="""SELECT quantile_cont(treo_max, 0.95) AS p95, quantile_cont(alt_clay, 0.5) AS m_clay,
      quantile_cont(alt_weath, 0.5) AS m_weath, quantile_cont(elevation, 0.5) AS m_elev
      FROM m LEFT JOIN alt USING (hole_id)""",
))
def geology_matrix(spark, sf):
    """Matrix with alteration flags, geology levels and scaled grades."""
    matrix = geology_features(
        view(spark, sf, "collar"), view(spark, sf, "assay"), view(spark, sf, "alteration"),
        _layer(spark, sf), ["unit_name"])
    return settled(matrix.select(
        "hole_id", "deposit", "alt_clay", "alt_weath", "elevation", "depth_score", "treo_norm",
        "geol_unit_name_NATION_12", "geol_unit_name_unknown"), treo_norm=6)


@query(over(
    ["collar"],
    f"""SELECT hole_id, {r('lon', 6)} AS lon, {r('lat', 6)} AS lat FROM collar""",
))
def projected_collar(spark, sf):
    """Collar given in metres, recognised as such and brought back to degrees."""
    metres = to_utm(view(spark, sf, "collar"), ZONE, south=True, x="e", y="n").select(
        "hole_id", F.col("e").alias("lon"), F.col("n").alias("lat"))
    placed = in_degrees(stage_table(metres, "metres"), ZONE, south=True)
    return settled(placed.select("hole_id", "lon", "lat"), 6)


_AT = """SELECT hole_id, CAST(floor((lat - (-28.8e0))/(-0.002e0)) AS INT) AS prow,
  CAST(floor((lon-122.5e0)/0.0025e0) AS INT) AS pcol FROM collar WHERE lon IS NOT NULL"""
_VALID = "SELECT prow, pcol, CASE WHEN val <> -9999 THEN val END AS val FROM pixels"


@query(over(
    ["collar", "pixels"],
    f"""SELECT hole_id, {r('val')} AS val FROM spot LEFT JOIN valid USING (prow, pcol)""",
    spot=_AT, valid=_VALID,
))
def raster_samples(spark, sf):
    sampled = raster.sample_pixels(_places(spark, sf), view(spark, sf, "pixels"), [MAGNETIC])
    return settled(sampled.select("hole_id", "val"))


@query(over(
    ["collar", "pixels"],
    f"""SELECT hole_id, {r('val')} AS val FROM spot LEFT JOIN valid USING (prow, pcol)""",
    spot=_AT, valid=_VALID,
))
def raster_tile_samples(spark, sf):
    tiles = raster.tiles_from_pixels(view(spark, sf, "pixels"))
    return settled(raster.sample_tiles(_places(spark, sf), tiles, [MAGNETIC]).select(
        "hole_id", "val"))


@query(over(
    ["collar", "pixels"],
    f"""SELECT collar.hole_id, {r('coalesce(val, m)')} AS r_tmi FROM collar
      LEFT JOIN v USING (hole_id) CROSS JOIN (SELECT quantile_cont(val, 0.5) AS m FROM v)""",
    spot=_AT, valid=_VALID, v="SELECT hole_id, val FROM spot LEFT JOIN valid USING (prow, pcol)",
))
def raster_layer(spark, sf):
    places = _places(spark, sf)
    samples = stage_table(
        raster.sample_pixels(places, view(spark, sf, "pixels"), [MAGNETIC]), "samples")
    return settled(raster.raster_features(places, samples, "hole_id", [MAGNETIC], "r_"))


@query(over(
    ["collar", "pixels"],
    f"""SELECT hole_id, {r('coalesce(avg(val),0e0)')} AS mean,
      {r('coalesce(stddev_pop(val),0e0)')} AS std, {r('coalesce(max(val),0e0)')} AS max
    FROM spot LEFT JOIN valid v ON v.prow BETWEEN spot.prow-1 AND spot.prow+1
      AND v.pcol BETWEEN spot.pcol-1 AND spot.pcol+1 GROUP BY hole_id""",
    spot=_AT, valid=_VALID,
))
def raster_focal_statistics(spark, sf):
    stats = raster.focal_statistics(
        _places(spark, sf), view(spark, sf, "pixels"), [MAGNETIC])
    return settled(stats.select("hole_id", "mean", "std", "max"))


@query(over(
    ["collar"],
    """SELECT 'tmi' AS raster_id, count(*) AS points,
      count(*) FILTER (prow < 0 OR prow > 49 OR pcol < 0 OR pcol > 39) AS outside FROM spot""",
    spot=_AT,
))
def raster_bounds(spark, sf):
    return raster.outside_bounds(_places(spark, sf), MAGNETIC)


@query(over(
    ["bands"],
    "SELECT point_id, " + ", ".join(
        r(f"CASE WHEN {b} > 0 THEN ({a})/({b}) ELSE 0 END", 6) + f" AS si_{n}"
        for n, a, b in (
            ("ndvi", "nir-red", "nir+red"), ("iron_oxide", "red", "blue"),
            ("ferric_iron", "red", "green"), ("clay_index", "swir1", "swir2"),
            ("ndwi", "nir-swir1", "nir+swir1"), ("alteration", "swir1", "red"),
        )) + " FROM bands",
))
def spectral_index_table(spark, sf):
    rows = view(spark, sf, "bands")
    bands = {b: F.col(b) for b in ("blue", "green", "red", "nir", "swir1", "swir2")}
    indices = spectral_indices(bands)
    return rows.select("point_id", *[rounded(c, 6).alias(n) for n, c in indices.items()])


_GRID = {
    "e": "SELECT min(lon) lon0, max(lon) lon1, min(lat) lat0, max(lat) lat1 FROM collar",
    "g": """SELECT *, 100e0/111320 AS dlat,
      100e0/(111320*cos(radians((lat0+lat1)/2))) AS dlon FROM e""",
    "n": """SELECT *, CAST(ceil((lat1+dlat-lat0)/dlat) AS BIGINT) AS nr,
      CAST(ceil((lon1+dlon-lon0)/dlon) AS BIGINT) AS nc FROM g""",
    "cells": """SELECT rr AS grow, cc AS gcol, lon0+cc*dlon AS lon, lat0+rr*dlat AS lat
      FROM n, range(nr) a(rr), range(nc) b(cc)""",
}


@query(over(
    ["collar"],
    f"SELECT grow, gcol, {r('lon', 7)} AS lon, {r('lat', 7)} AS lat FROM cells", **_GRID,
))
def prediction_grid(spark, sf):
    spec = grid.grid_spec(view(spark, sf, "collar"), 100.0)
    return settled(grid.grid_points(spark, spec).drop("cell_id"), 7)


_COARSE = {k: t.replace("100e0", "250e0") for k, t in _GRID.items()}


@query(over(
    ["collar", "assay", "pixels"],
    f"""SELECT grow, gcol, {r('tmax')} AS idw_treo_max, {r('tmean')} AS idw_treo_mean,
      {r('conf', 6)} AS idw_conf, {r('near_m')} AS nearest_m,
      {r('coalesce(v, (SELECT quantile_cont(v, 0.5) FROM px))')} AS g_tmi,
      {r('(lon-lon0)/(lon1-lon0+1e-9)', 6)} AS coord_lon_norm,
      {r('(lat-lat0)/(lat1-lat0+1e-9)', 6)} AS coord_lat_norm
    FROM est JOIN px USING (grow, gcol) CROSS JOIN e""",
    totals=TOTALS, hole=HOLE, **_COARSE,
    px="""SELECT grow, gcol, CASE WHEN val <> -9999 THEN val END AS v FROM cells
      LEFT JOIN pixels ON prow = floor((lat+28.8e0)/(-0.002e0))
      AND pcol = floor((lon-122.5e0)/0.0025e0)""",
    d="""SELECT grow, gcol, c.lon, c.lat, h.treo_max, h.treo_mean, h.hole_id,
      sqrt((h.lon-c.lon)*(h.lon-c.lon)+(h.lat-c.lat)*(h.lat-c.lat)) AS d
      FROM cells c JOIN hole h ON h.treo_max IS NOT NULL AND h.lon IS NOT NULL""",
    k="""SELECT *, 1/pow(greatest(d*111320,1e-6),2) AS w FROM d QUALIFY row_number() OVER
      (PARTITION BY grow, gcol ORDER BY d, hole_id) <= 8""",
    est="""SELECT grow, gcol, lon, lat, sum(w*treo_max)/sum(w) AS tmax,
      sum(w*treo_mean)/sum(w) AS tmean, min(d)*111320 AS near_m,
      1/(1+greatest(min(d)*111320,1e-6)/100) AS conf FROM k GROUP BY ALL""",
))
def grid_feature_table(spark, sf):
    """Grid features at 250 m: raster, interpolated grades, nearest hole, place."""
    features = grid_features(
        stage_table(hole_table(spark, sf), "grid-holes"), view(spark, sf, "pixels"),
        [MAGNETIC], ["treo_max", "treo_mean"], resolution_m=250.0,
    )
    return settled(features.select(
        "grow", "gcol", "idw_treo_max", "idw_treo_mean", "idw_conf", "nearest_m", "g_tmi",
        "coord_lon_norm", "coord_lat_norm",
    ), idw_conf=6, coord_lon_norm=6, coord_lat_norm=6)


@query(over(
    ["pixels"],
    f"""SELECT ox, oy, {r('CASE WHEN bool_or(w > 0 AND v IS NULL) THEN 0e0 ELSE '
      'least(greatest(sum(coalesce(v,0e0)*w),0e0),1e0) END', 6)} AS heat
    FROM corners LEFT JOIN nodes USING (grow, gcol) GROUP BY ox, oy""",
    nodes="SELECT prow AS grow, pcol AS gcol, (val % 100)/100e0 AS v FROM pixels "
          "WHERE val > 0",
    size="SELECT max(prow) AS r, max(pcol) AS c FROM pixels",
    o="""SELECT ox, oy, r, c, ox*(c*1e0/299) AS gx, oy*(r*1e0/299) AS gy
      FROM size, range(300) a(ox), range(300) b(oy)""",
    q="""SELECT *, least(floor(gx), c - 1) AS c0, least(floor(gy), r - 1) AS r0 FROM o""",
    corners="""SELECT ox, oy, CAST(r0+dr AS INT) AS grow, CAST(c0+dc AS INT) AS gcol,
      (CASE WHEN dc=1 THEN gx-c0 ELSE 1-(gx-c0) END)
      *(CASE WHEN dr=1 THEN gy-r0 ELSE 1-(gy-r0) END) AS w
      FROM q, range(2) a(dr), range(2) b(dc)""",
))
def smooth_surface(spark, sf):
    """All pixels, extent taken from them, drawn at 300 x 300."""
    pixels = view(spark, sf, "pixels")
    last = pixels.agg(F.max("prow").alias("r"), F.max("pcol").alias("c")).first()
    spec = grid.GridSpec(0.0, 0.0, 1.0, 1.0, cols=last["c"] + 1, rows=last["r"] + 1)
    nodes = pixels.filter("val > 0").select(
        F.col("prow").alias("grow"), F.col("pcol").alias("gcol"),
        (F.col("val") % 100 / 100).alias("heat"),
    )
    return settled(grid.resampled(spark, nodes, spec, "heat", size=300), 6)


@query(over(
    ["preds"],
    """SELECT CAST((score >= 0.4)::INT + (score >= 0.6)::INT + (score >= 0.75)::INT
      + (score >= 0.85)::INT AS INT) AS band, count(*) AS cells, count(*)*100e0 AS area_m2
    FROM preds GROUP BY 1""",
))
def contour_bands(spark, sf):
    return grid.band_areas(view(spark, sf, "preds"), "score", 10.0)


@query(over(
    ["collar"],
    f"""SELECT zoom, CAST(floor((lon+180)/360*pow(2,zoom)) AS BIGINT) AS tile_x,
      CAST(floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*pow(2,zoom)) AS BIGINT)
        AS tile_y, count(*) AS points, {r('avg(maxdepth)/100', 6)} AS heat
    FROM collar, (VALUES (10), (12), (14)) z(zoom)
    WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2, 3""",
))
def heat_map_cells(spark, sf):
    return settled(grid.map_cells(view(spark, sf, "collar"), "maxdepth", [10, 12, 14]), 6)


_ZONED = placed.Placement(
    "utm", x0=450_000.0, y0=6_815_000.0, xc=260.0, xr=0.0, yc=0.0, yr=-240.0, rows=50, cols=40,
    nodata=-9999.0, zone=ZONE, south=True)
_TURNED = placed.Placement(
    "turned", x0=122.52, y0=-28.78, xc=0.0025, xr=0.0009, yc=0.0007, yr=-0.0021, rows=50, cols=40,
    nodata=-9999.0)


def _own_pixels(spark, sf, raster_id):
    return view(spark, sf, "pixels").select(F.lit(raster_id).alias("raster_id"), "prow", "pcol", "val")


def _one_placed(spark, sf, raster):
    rasters = placed.catalogue(placed.placements(spark, [raster]))
    tiles = rim_tiles(_own_pixels(spark, sf, raster.raster_id))
    return placed.sample_placed(_places(spark, sf), tiles, rasters).select(
        "hole_id", "prow", "pcol", rounded(F.col("val")).alias("val"))


def _placed_sql(x, y, source, p):
    """Pixel of a placement below (x, y) of ``source``, and its value."""
    det = p.xc * p.yr - p.xr * p.yc
    return f"""SELECT hole_id, CAST(prow AS INT) AS prow, CAST(pcol AS INT) AS pcol, {r('v.val')} AS val
      FROM (SELECT hole_id, floor(({-p.yc / det!r})*e + ({p.xc / det!r})*n) AS prow,
        floor(({p.yr / det!r})*e + ({-p.xr / det!r})*n) AS pcol FROM (
          SELECT hole_id, {x} - ({p.x0!r}) AS e, {y} - ({p.y0!r}) AS n FROM {source}
          WHERE lon IS NOT NULL AND lat IS NOT NULL)) place
      LEFT JOIN valid v USING (prow, pcol)
      WHERE prow BETWEEN 0 AND {p.rows - 1} AND pcol BETWEEN 0 AND {p.cols - 1}"""


@query(over(["collar", "pixels"], _placed_sql("x", "y", "u", _ZONED), **_FORWARD_STEPS, valid=_VALID))
def raster_projected_samples(spark, sf):
    """A raster in UTM metres sampled at holes in degrees."""
    return _one_placed(spark, sf, _ZONED)


@query(over(["collar", "pixels"], _placed_sql("lon", "lat", "collar", _TURNED), valid=_VALID))
def raster_rotated_samples(spark, sf):
    """A rotated and sheared raster, by the full inverse of its placement."""
    return _one_placed(spark, sf, _TURNED)


_SHEET = """SELECT CAST(i AS INT) AS i, 'sheet' || i AS raster_id, 122.49e0 + (i % 25)*0.005e0 AS x0,
  -28.79e0 - (i // 25)*0.006e0 AS y0, 0.01e0/40 AS dx, -0.006e0/50 AS dy FROM range(500) t(i)"""


@query(over(
    ["collar", "pixels"],
    f"""SELECT hole_id, raster_id, {r('coalesce(avg(val),0e0)')} AS mean,
      {r('coalesce(stddev_pop(val),0e0)')} AS std, {r('coalesce(max(val),0e0)')} AS max
    FROM (SELECT p.hole_id, p.raster_id, v.val + i AS val FROM place p LEFT JOIN valid v
      ON v.prow BETWEEN p.prow-1 AND p.prow+1 AND v.pcol BETWEEN p.pcol-1 AND p.pcol+1)
    GROUP BY hole_id, raster_id""",
    valid=_VALID, sheet=_SHEET,
    place="""SELECT * FROM (SELECT hole_id, raster_id, i,
      floor((0*(-1e0)/(dx*dy))*(lon - x0) + (dx/(dx*dy - 0*0))*(lat - y0)) AS prow,
      floor((dy/(dx*dy - 0*0))*(lon - x0) + (-0e0/(dx*dy))*(lat - y0)) AS pcol
      FROM collar, sheet WHERE lon IS NOT NULL AND lat IS NOT NULL)
      WHERE prow BETWEEN 0 AND 49 AND pcol BETWEEN 0 AND 39""",
))
def raster_sheet_statistics(spark, sf):
    """Windows in a catalogue of 500 overlapping sheets; a hole lies on two of them at most."""
    number = F.col("id")
    each = F.explode(F.sequence(F.lit(0), F.lit(499)))
    sheets = spark.range(500).select(
        F.concat(F.lit("sheet"), number).alias("raster_id"),
        (F.lit(122.49) + number % 25 * 0.005).alias("x0"),
        (F.lit(-28.79) - F.expr("id div 25") * 0.006).alias("y0"),
        F.lit(0.01 / 40).alias("xc"), F.lit(0.0).alias("xr"), F.lit(0.0).alias("yc"),
        F.lit(-0.006 / 50).alias("yr"), F.lit(50).alias("rows"), F.lit(40).alias("cols"),
        F.lit(None).cast("double").alias("nodata"), F.lit(None).cast("int").alias("zone"),
        F.lit(None).cast("boolean").alias("south"))
    # the same pixels for all sheets, each on a level of its own
    usable = raster.masked(F.col("val"), F.col("raster_id"), [MAGNETIC])
    own = view(spark, sf, "pixels").withColumn("val", usable).filter("val IS NOT NULL")
    # 500 rows come of one, so all tasks get their share before that
    pixels = own.repartition(spark.sparkContext.defaultParallelism).withColumn("id", each).select(
        F.concat(F.lit("sheet"), "id").alias("raster_id"), "prow", "pcol", (F.col("val") + F.col("id")).alias("val"))
    found = placed.focal_placed(_places(spark, sf), rim_tiles(pixels), placed.catalogue(sheets))
    return settled(found.select("hole_id", "raster_id", "mean", "std", "max"))
