"""Queries over collar, assay and attribute tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks import fixedvalues as fv
from lodeworks.checks.registry import over, query, r, rounded, settled
from lodeworks.functions.geochem import (
    depth_score, log_grade, scaled_label,
)
from lodeworks.functions.numeric import finite_or_zero, score_100, to_number
from lodeworks.functions.report import (
    colour_band, geojson_feature, grade_label, percent_grade, section_points,
)
from lodeworks.operators import columns as cols
from lodeworks.operators import holes, metrics
from lodeworks.operators.attributes import oxide_of
from lodeworks.operators.exact import exact_quantiles
from lodeworks.operators.grid import located
from lodeworks.operators.versions import content_hash, top_ranked
from lodeworks.plans import holes as plans
from lodeworks.session import stage_table
from lodeworks.sources.tables import table, view

ATTRIBUTES = ["click", "error", "purchase", "signup", "view"]

TOTALS = """SELECT *,
  CASE WHEN coalesce(ceo2_ppm,la2o3_ppm,nd2o3_ppm,dy2o3_ppm) IS NULL THEN NULL
    ELSE coalesce(ceo2_ppm,0e0)+coalesce(la2o3_ppm,0e0)+coalesce(nd2o3_ppm,0e0)
         +coalesce(dy2o3_ppm,0e0) END AS treo,
  coalesce(ceo2_ppm,0e0)+coalesce(la2o3_ppm,0e0)+coalesce(nd2o3_ppm,0e0) AS lree,
  coalesce(dy2o3_ppm,0e0) AS hree FROM assay"""
RATIOS = """SELECT *, lree/(hree+0.001e0) AS lree_hree_ratio,
  ceo2_ppm/(la2o3_ppm+1e0) AS ce_la_ratio, p2o5_ppm/(fe2o3_ppm+1e0) AS p_fe_ratio,
  tho2_ppm/(u3o8_ppm+0.001e0) AS th_u_ratio FROM totals"""
MEASURES = [
    "ceo2_ppm", "la2o3_ppm", "nd2o3_ppm", "dy2o3_ppm", "treo", "lree", "hree",
    "lree_hree_ratio", "ce_la_ratio", "p_fe_ratio", "th_u_ratio",
]
AGGREGATES = (
    "SELECT hole_id, "
    + ", ".join(f"max({m}) AS {m}_max, avg({m}) AS {m}_mean" for m in MEASURES)
    + ", min(fromdepth) AS fromdepth_min, max(todepth) AS todepth_max"
    + " FROM ratios GROUP BY hole_id"
)
HOLE = """SELECT c.hole_id, c.deposit, c.lon, c.lat, c.elevation, c.maxdepth,
  max(t.treo) AS treo_max, avg(t.treo) AS treo_mean, min(t.fromdepth) AS fromdepth_min
FROM collar c LEFT JOIN totals t ON c.hole_id = t.hole_id GROUP BY ALL"""
LADDER = """CASE WHEN fromdepth_min IS NULL THEN 0.5e0 WHEN fromdepth_min<20 THEN 1e0
  WHEN fromdepth_min<50 THEN 0.95e0 WHEN fromdepth_min<100 THEN 0.85e0
  WHEN fromdepth_min<200 THEN 0.65e0 ELSE 0.35e0 END"""


def hole_table(spark, sf):
    """Collar with the grade summary used by several queries."""
    totals = holes.add_interval_totals(view(spark, sf, "assay"))
    graded = totals.groupBy("hole_id").agg(
        F.max("treo").alias("treo_max"), F.avg("treo").alias("treo_mean"),
        F.min("fromdepth").alias("fromdepth_min"),
    )
    return view(spark, sf, "collar").join(graded, "hole_id", "left")


@query(over(
    ["collar", "assay"],
    f"""SELECT hole_id, deposit, {r('treo_max')} AS treo_max, {r('treo_mean')} AS treo_mean,
      {LADDER} AS depth_score, {r('least(greatest(treo_max/p95,0e0),1e0)', 6)} AS y
    FROM hole CROSS JOIN p ORDER BY hole.treo_max DESC NULLS LAST, hole_id LIMIT 50""",
    totals=TOTALS, hole=HOLE, p="SELECT quantile_cont(treo_max, 0.95) AS p95 FROM hole",
))
def ranked_targets(spark, sf):
    """Flagship: grade-ranked holes with label and depth score."""
    best = plans.labelled_targets(view(spark, sf, "collar"), view(spark, sf, "assay"))
    return settled(best, y=6)


@query(over(
    ["assay_long"],
    """SELECT hole_id, attributecolumn, attributevalue,
      CASE WHEN regexp_full_match(trim(attributevalue),
        '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
        THEN TRY_CAST(trim(attributevalue) AS DOUBLE) END AS number FROM assay_long""",
))
def numeric_coercion(spark, sf):
    rows = view(spark, sf, "assay_long")
    return rows.withColumn("number", to_number(F.col("attributevalue")))


@query(over(
    ["assay"],
    f"""SELECT hole_id, sample_id, fromdepth, {r('treo')} AS treo, {r('lree')} AS lree,
      {r('hree')} AS hree, {r('lree_hree_ratio')} AS lree_hree_ratio,
      {r('ce_la_ratio')} AS ce_la_ratio, {r('p_fe_ratio')} AS p_fe_ratio,
      {r('th_u_ratio')} AS th_u_ratio FROM ratios""",
    totals=TOTALS, ratios=RATIOS,
))
def interval_totals(spark, sf):
    rows = holes.add_interval_totals(view(spark, sf, "assay"))
    return settled(rows.select(
        "hole_id", "sample_id", "fromdepth", "treo", "lree", "hree",
        "lree_hree_ratio", "ce_la_ratio", "p_fe_ratio", "th_u_ratio",
    ))


@query(over(
    ["assay"],
    "SELECT hole_id, "
    + ", ".join(f"{r(f'{m}_{f}')} AS {m}_{f}" for m in MEASURES for f in ("max", "mean"))
    + ", fromdepth_min, todepth_max FROM agg",
    totals=TOTALS, ratios=RATIOS, agg=AGGREGATES,
))
def hole_aggregates(spark, sf):
    rows = holes.add_interval_totals(view(spark, sf, "assay"))
    out = holes.hole_aggregates(rows)
    return settled(out).withColumns({
        c: F.col(c) for c in ("fromdepth_min", "todepth_max")
    })


@query(over(
    ["assay_long"],
    "SELECT hole_id, " + ", ".join(
        f"max(TRY_CAST(attributevalue AS DOUBLE)) FILTER (attributecolumn='{a}') AS {a}_geo"
        for a in ATTRIBUTES) + " FROM assay_long WHERE hole_id IS NOT NULL GROUP BY hole_id",
))
def attribute_pivot(spark, sf):
    rows = view(spark, sf, "assay_long")
    return holes.pivot_attributes(rows, holes.attribute_names(rows), "_geo")


@query(over(
    ["alteration"],
    "SELECT hole_id, " + ", ".join(
        f"count(*) FILTER (lower(attributevalue) LIKE '%{w}%') AS is_{w}"
        for w in fv.ALTERATION_WORDS) + " FROM alteration GROUP BY hole_id",
))
def alteration_counts(spark, sf):
    return holes.alteration_counts(view(spark, sf, "alteration"))


@query(over(
    ["alteration"],
    "SELECT hole_id, " + ", ".join(
        f"max(CASE WHEN lower(attributevalue) LIKE '%{w}%' THEN 1 ELSE 0 END) AS alt_{w}"
        for w in fv.ALTERATION_WORDS[:-1]) + " FROM alteration GROUP BY hole_id",
))
def alteration_flags(spark, sf):
    return holes.alteration_flags(view(spark, sf, "alteration"))


@query(over(
    ["collar", "assay", "assay_long", "alteration"],
    f"""SELECT c.hole_id, deposit, lon, lat, elevation, maxdepth,
      {r('treo_max')} AS treo_max, {r('treo_mean')} AS treo_mean,
      {r('ceo2_ppm_mean')} AS ceo2_ppm_mean, fromdepth_min, todepth_max,
      error_geo, view_geo, coalesce(is_clay, 0) AS is_clay,
      coalesce(is_ferrugin, 0) AS is_ferrugin, {LADDER} AS depth_score
    FROM collar c LEFT JOIN agg a ON c.hole_id=a.hole_id
      LEFT JOIN geo g ON c.hole_id=g.hole_id LEFT JOIN alt t ON c.hole_id=t.hole_id""",
    totals=TOTALS, ratios=RATIOS, agg=AGGREGATES,
    geo="""SELECT hole_id,
      max(TRY_CAST(attributevalue AS DOUBLE)) FILTER (attributecolumn='error') AS error_geo,
      max(TRY_CAST(attributevalue AS DOUBLE)) FILTER (attributecolumn='view') AS view_geo
      FROM assay_long GROUP BY hole_id""",
    alt="""SELECT hole_id, count(*) FILTER (lower(attributevalue) LIKE '%clay%') AS is_clay,
      count(*) FILTER (lower(attributevalue) LIKE '%ferrugin%') AS is_ferrugin
      FROM alteration GROUP BY hole_id""",
))
def hole_master(spark, sf):
    master = plans.build_master(
        view(spark, sf, "collar"), view(spark, sf, "assay"),
        view(spark, sf, "assay_long"), ATTRIBUTES, view(spark, sf, "alteration"),
    )
    return master.select(
        "hole_id", "deposit", "lon", "lat", "elevation", "maxdepth",
        *[rounded(F.col(c)).alias(c) for c in ("treo_max", "treo_mean", "ceo2_ppm_mean")],
        "fromdepth_min", "todepth_max", "error_geo", "view_geo", "is_clay", "is_ferrugin",
        "depth_score",
    )


@query(over(
    ["collar", "alteration"],
    """SELECT hole_id, attributevalue FROM alteration
    WHERE hole_id IN (SELECT hole_id FROM collar WHERE lon IS NOT NULL)""",
))
def known_holes_only(spark, sf):
    collar = view(spark, sf, "collar").filter("lon IS NOT NULL")
    return holes.known_holes(view(spark, sf, "alteration"), collar)


@query(over(
    ["collar", "assay"],
    f"""SELECT hole_id, deposit, {r('treo_max')} AS treo_max FROM hole
    WHERE treo_max IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) < 90""",
    totals=TOTALS, hole=HOLE,
))
def labelled_located_holes(spark, sf):
    rows = hole_table(spark, sf).filter(F.col("treo_max").isNotNull() & located())
    return settled(rows.select("hole_id", "deposit", "treo_max"))


_REPORT = [
    ("hole_id", False, False), ("deposit", False, False), ("lon", True, False),
    ("lat", True, False), ("elevation", True, True), ("maxdepth", True, True),
    ("treo_max", True, False), ("treo_mean", True, False), ("fromdepth_min", True, True),
]


@query(over(
    ["collar", "assay"],
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, count({n}) AS present, {num} AS is_number, "
        f"{'treo' in n} AS leaks, {ok} AND count({n}) > 0 AS chosen FROM hole"
        for n, num, ok in _REPORT),
    totals=TOTALS, hole=HOLE,
))
def column_selection(spark, sf):
    return cols.column_report(hole_table(spark, sf))


@query(over(
    ["assay"],
    f"""SELECT sample_id, fromdepth,
      {r('CASE WHEN q IS NULL OR isnan(q) OR isinf(q) THEN 0e0 ELSE q END', 6)} AS q
    FROM (SELECT *, CASE WHEN u3o8_ppm = 0 THEN CASE WHEN tho2_ppm > 0
      THEN 'Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END
      ELSE ceo2_ppm/u3o8_ppm END AS q FROM assay)""",
))
def sanitised_values(spark, sf):
    rows = view(spark, sf, "assay")
    zero = F.col("u3o8_ppm") == 0
    special = F.when(F.col("tho2_ppm") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    value = F.when(zero, special).otherwise(F.try_divide("ceo2_ppm", "u3o8_ppm"))
    return rows.select(
        "sample_id", "fromdepth", rounded(finite_or_zero(value), 6).alias("q")
    )


def _ladder_sql(name, column):
    steps, beyond = fv.DEPTH_LADDERS[name]
    cases = " ".join(f"WHEN {column} < {b} THEN {v}e0" for b, v in steps)
    return f"CASE WHEN {column} IS NULL THEN 0.5e0 {cases} ELSE {beyond}e0 END"


@query(over(
    ["collar"],
    "SELECT hole_id, " + ", ".join(
        f"{_ladder_sql(n, 'd')} AS {n}_score" for n in fv.DEPTH_LADDERS)
    + """ FROM (SELECT hole_id, CASE WHEN lon IS NULL THEN NULL ELSE maxdepth*1.2e0 END AS d
      FROM collar)""",
))
def depth_scores(spark, sf):
    depth = F.when(F.col("lon").isNotNull(), F.col("maxdepth") * 1.2)
    return view(spark, sf, "collar").select(
        "hole_id", *[depth_score(depth, n).alias(f"{n}_score") for n in fv.DEPTH_LADDERS]
    )


@query(over(
    ["collar"],
    f"""SELECT hole_id, {r('(lon-lon0)/(lon1-lon0+1e-9)', 6)} AS coord_lon_norm,
      {r('(lat-lat0)/(lat1-lat0+1e-9)', 6)} AS coord_lat_norm,
      {r('''sqrt(pow((lon-clon)*111320e0*cos(radians(clat)),2)
         +pow((lat-clat)*111320e0,2))/500e0''', 6)} AS dist_centroid
    FROM collar CROSS JOIN s""",
    s="""SELECT min(lon) lon0, max(lon) lon1, min(lat) lat0, max(lat) lat1,
      quantile_cont(lon,0.5) clon, quantile_cont(lat,0.5) clat FROM collar""",
))
def place_features(spark, sf):
    placed = plans.with_place_features(view(spark, sf, "collar"))
    return settled(
        placed.select("hole_id", "coord_lon_norm", "coord_lat_norm", "dist_centroid"), 6
    )


@query(over(
    ["collar", "assay"],
    f"""SELECT hole_id,
      {r('CASE WHEN treo_max IS NOT NULL THEN ln(1+greatest(treo_max,0e0)) END', 6)} AS treo_max,
      {r('CASE WHEN elevation IS NOT NULL THEN ln(1+greatest(elevation,0e0)) END', 6)}
        AS elevation FROM hole""",
    totals=TOTALS, hole=HOLE,
))
def log_scaled_grades(spark, sf):
    return hole_table(spark, sf).select("hole_id", *[
        rounded(log_grade(F.col(c)), 6).alias(c) for c in ("treo_max", "elevation")
    ])


@query(over(
    ["collar", "assay"],
    f"SELECT hole_id, {r('least(greatest(treo_max/p95,0e0),1e0)', 6)} AS y"
    " FROM hole CROSS JOIN p WHERE treo_max IS NOT NULL",
    totals=TOTALS, hole=HOLE, p="SELECT quantile_cont(treo_max, 0.95) AS p95 FROM hole",
))
def scaled_labels(spark, sf):
    master = stage_table(hole_table(spark, sf).select("hole_id", "treo_max"), "labels")
    p95 = plans.label_p95(master)
    labelled = master.filter("treo_max IS NOT NULL")
    return labelled.select(
        "hole_id", rounded(scaled_label(F.col("treo_max"), p95), 6).alias("y")
    )


@query(over(
    ["polygons"],
    "SELECT poly_id, "
    + ", ".join(f"CASE WHEN grp='G{i}' THEN 1 ELSE 0 END AS grp_G{i}" for i in range(1, 5))
    + ", CASE WHEN grp='unknown' THEN 1 ELSE 0 END AS grp_unknown FROM (SELECT poly_id,"
    " CASE WHEN poly_id % 6 = 5 THEN 'unknown' ELSE concat('G', (poly_id % 6)::VARCHAR)"
    " END AS grp FROM polygons)",
))
def one_hot_levels(spark, sf):
    level = F.when(F.col("poly_id") % 6 != 5, F.concat(F.lit("G"), F.col("poly_id") % 6))
    rows = view(spark, sf, "polygons").select("poly_id", level.alias("grp"))
    return cols.one_hot(rows, "grp").drop("grp")


@query(over(
    ["preds"],
    """SELECT row_id, round_even(least(greatest(score*1.25e0 - 0.1e0, 0e0), 1e0)*100, 1)
      AS score_100 FROM preds""",
))
def prospectivity_scores(spark, sf):
    return view(spark, sf, "preds").select(
        "row_id", score_100(F.col("score") * 1.25 - 0.1).alias("score_100")
    )


@query(over(
    ["collar", "assay"],
    f"""SELECT hole_id, {r('coalesce(elevation,0e0)-coalesce(fromdepth_min,0e0)')} AS depth_z,
      {r('''CASE WHEN big > 1000 THEN ln(1+greatest(coalesce(treo_max,0e0),0e0))
        ELSE greatest(coalesce(treo_max,0e0),0e0) END''', 6)} AS size_viz
    FROM hole CROSS JOIN (SELECT max(treo_max) AS big FROM hole)""",
    totals=TOTALS, hole=HOLE,
))
def section_records(spark, sf):
    master = stage_table(hole_table(spark, sf), "section")
    points = section_points(master, "fromdepth_min", "treo_max")
    return settled(points.select("hole_id", "depth_z", "size_viz"), size_viz=6)


@query(over(
    ["collar", "assay"],
    """SELECT hole_id, score, lat, lon,
      CASE WHEN score >= 75 THEN 'high' WHEN score >= 60 THEN 'middle' ELSE 'low' END AS colour,
      CASE WHEN score > 70 THEN 'high' WHEN score > 55 THEN 'middle' ELSE 'low' END AS map_colour,
      CASE WHEN treo_max IS NULL THEN 'predicted'
        ELSE concat(format('{:,}', CAST(round_even(treo_max, 0) AS BIGINT)), ' ppm') END AS label
    FROM (SELECT *, (maxdepth*7 % 101) AS score FROM hole
      WHERE lat IS NOT NULL AND abs(lat) < 90)
    ORDER BY score DESC, hole_id LIMIT 30""",
    totals=TOTALS, hole=HOLE,
))
def map_markers(spark, sf):
    rows = hole_table(spark, sf).filter(located()).withColumn(
        "score", F.col("maxdepth") * 7 % 101)
    best = top_ranked(rows, "score", "hole_id", 30)
    score = F.col("score")
    return best.select(
        "hole_id", "score", "lat", "lon",
        colour_band(score, 75, 60, inclusive=True).alias("colour"),
        colour_band(score, 70, 55, inclusive=False).alias("map_colour"),
        grade_label(F.col("treo_max"), "predicted").alias("label"),
    )


@query(over(
    ["preds"],
    f"""SELECT row_id, {r('score*5400e0/10000e0', 6)} AS treo_pct FROM preds""",
))
def percent_grades(spark, sf):
    return view(spark, sf, "preds").select(
        "row_id", rounded(percent_grade(F.col("score"), 5400.0), 6).alias("treo_pct")
    )


_MATRIX = ["elevation", "maxdepth", "ceo2_ppm_max", "la2o3_ppm_mean", "ce_la_ratio_mean",
           "fromdepth_min", "depth_score"]


@query(over(
    ["collar", "assay"],
    "SELECT hole_id, deposit, lat, lon, " + ", ".join(
        r(f"ln(1+greatest(coalesce({c}, m_{c}, 0e0),0e0))" if "ppm" in c or "ratio" in c
          else f"coalesce({c}, m_{c}, 0e0)", 5) + f" AS {c}" for c in _MATRIX)
    + " FROM m CROSS JOIN s",
    totals=TOTALS, ratios=RATIOS, agg=AGGREGATES,
    m=f"SELECT c.*, a.* EXCLUDE (hole_id), {LADDER} AS depth_score "
      "FROM collar c LEFT JOIN agg a ON c.hole_id=a.hole_id",
    s="SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _MATRIX) + " FROM m",
))
def feature_matrix(spark, sf):
    master = plans.build_master(view(spark, sf, "collar"), view(spark, sf, "assay"))
    matrix, _ = plans.feature_matrix(stage_table(master, "master"))
    return matrix.select("hole_id", "deposit", "lat", "lon", *[
        rounded(F.col(c), 5).alias(c) for c in _MATRIX
    ])


@query(over(
    ["collar", "assay"],
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS present, {r(f'min({c})')} AS low, "
        f"{r(f'max({c})')} AS high, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
        f"{r(f'quantile_cont({c}, 0.5)')} AS median FROM hole"
        for c in ("elevation", "maxdepth", "treo_max", "lon")),
    totals=TOTALS, hole=HOLE,
))
def column_statistics(spark, sf):
    master = stage_table(hole_table(spark, sf), "stats")
    return settled(metrics.column_statistics(
        master, ["elevation", "maxdepth", "treo_max", "lon"]))


@query(over(
    ["assay"],
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, {p}e0 AS p, {r(f'quantile_cont({c}, {p})')} AS q FROM totals"
        for c in ("treo", "fe2o3_ppm") for p in (0.7, 0.95, 0.99)),
    totals=TOTALS,
))
def grade_quantiles(spark, sf):
    rows = stage_table(holes.add_interval_totals(view(spark, sf, "assay")).select(
        "treo", "fe2o3_ppm"), "grades")
    found = exact_quantiles(rows, ["treo", "fe2o3_ppm"], [0.7, 0.95, 0.99])
    out = [(c, p, q) for c, qs in found.items() for p, q in zip([0.7, 0.95, 0.99], qs)]
    return settled(spark.createDataFrame(out, "name string, p double, q double"))


@query(over(
    ["collar", "assay"],
    f"""SELECT count(*) AS holes, {r('''(avg((hole_id IS NULL)::INT)+avg((lon IS NULL)::INT)
        +avg((lat IS NULL)::INT)+avg((treo_max IS NULL)::INT)
        +avg((treo_mean IS NULL)::INT))/5*100''', 6)} AS missing_pct,
      count(*) FILTER (lat < -90 OR lat > 90) AS coord_outliers,
      count(*) FILTER (treo_max > q) AS high_grades,
      (avg((hole_id IS NULL)::INT)+avg((lon IS NULL)::INT)+avg((lat IS NULL)::INT)
        +avg((treo_max IS NULL)::INT)+avg((treo_mean IS NULL)::INT))/5*100 < 20 AS healthy
    FROM hole CROSS JOIN (SELECT quantile_cont(treo_max, 0.99) AS q FROM hole)""",
    totals=TOTALS, hole=HOLE,
))
def data_health(spark, sf):
    rows = hole_table(spark, sf).select("hole_id", "lon", "lat", "treo_max", "treo_mean")
    return settled(metrics.data_health(stage_table(rows, "health"), "treo_max"), 6)


@query(over(
    ["collar", "assay"],
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS present, "
        f"count(*) FILTER (abs({c}) > 0.001) AS nonzero, {r(f'avg({c})')} AS mean, "
        f"{r(f'stddev_pop({c})')} AS std FROM hole"
        for c in ("treo_max", "elevation", "fromdepth_min")),
    totals=TOTALS, hole=HOLE,
))
def layer_coverage(spark, sf):
    return settled(metrics.coverage(
        hole_table(spark, sf), ["treo_max", "elevation", "fromdepth_min"]))


# Attribute spellings derived from event ids, and the oxide each stands for.
_SPELLINGS = [
    ("CeO2_ppm", "ceo2"), ("la2o3", "la2o3"), ("Nd2O3_pct", "nd2o3"), ("ceo_2", "ceo2"),
    ("al2o3_ppm", None), ("fe2o3_ppm", None), ("cr2o3", None), ("ho2o3_ppm", "ho2o3"),
    ("pr6o1", "pr6o11"), ("sio2", None), ("y2o3", "y2o3"), ("sc2o3", None),
    ("dy2_o3", "dy2o3"), ("b2o3", None),
]


@query(
    "SELECT attribute, oxide, count(*) AS rows FROM (SELECT CASE event_id % 14 "
    + " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(_SPELLINGS))
    + " END AS attribute, CASE event_id % 14 "
    + " ".join(f"WHEN {i} THEN {repr(o) if o else 'NULL'}"
               for i, (_, o) in enumerate(_SPELLINGS))
    + " END AS oxide FROM events) GROUP BY attribute, oxide"
)
def oxide_attributes(spark, sf):
    """Loosely spelled attribute names mapped to oxides, over distinct names."""
    position = (F.col("event_id") % 14).cast("int") + 1
    spelled = F.element_at(F.array(*[F.lit(s) for s, _ in _SPELLINGS]), position)
    rows = table(spark, sf, "events").select(spelled.alias("attribute"))
    names = rows.groupBy("attribute").agg(F.count(F.lit(1)).alias("rows"))
    return names.select("attribute", oxide_of(F.col("attribute")).alias("oxide"), "rows")


@query(over(
    ["collar"],
    """SELECT concat('{"type":"Feature","geometry":{"type":"Point","coordinates":[',
      lon::VARCHAR, ',', lat::VARCHAR, ']},"properties":{"hole_id":"', hole_id,
      '","deposit":"', deposit, '","maxdepth":', maxdepth::VARCHAR, '}}') AS feature
    FROM collar WHERE lon IS NOT NULL AND lat IS NOT NULL""",
))
def geojson_features(spark, sf):
    rows = view(spark, sf, "collar").select("hole_id", "deposit", "maxdepth", "lon", "lat")
    placed = rows.filter("lon IS NOT NULL AND lat IS NOT NULL")
    return placed.select(geojson_feature(rows.columns).alias("feature"))


@query(over(
    ["collar"],
    """SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256(
      concat_ws('|', hole_id, deposit, coalesce(CAST(CAST(maxdepth AS BIGINT) AS VARCHAR), ''))
      ), 1, 15) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM collar""",
))
def training_digest(spark, sf):
    rows = view(spark, sf, "collar").withColumn("maxdepth", F.col("maxdepth").cast("long"))
    return content_hash(rows, ["hole_id", "deposit", "maxdepth"])


@query(over(
    ["collar", "assay"],
    f"""SELECT deposit, hole_id, {r('treo_max')} AS treo_max, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY deposit
        ORDER BY treo_max DESC NULLS LAST, hole_id) AS INT) AS rank FROM hole)
    WHERE rank <= 20""",
    totals=TOTALS, hole=HOLE,
))
def top_targets_per_deposit(spark, sf):
    best = top_ranked(hole_table(spark, sf), "treo_max", "hole_id", 20, group="deposit")
    return settled(best.select("deposit", "hole_id", "treo_max", "rank"))


@query(over(
    ["collar", "assay"],
    f"""SELECT {", ".join(
        f"{r(f'(treo_mean-m)/w' if c == 'treo_mean' else f'({c}-m2)/w2', 5)} AS {c}"
        for c in ('treo_mean', 'elevation'))}, hole_id
    FROM hole CROSS JOIN s WHERE treo_mean IS NOT NULL""",
    totals=TOTALS, hole=HOLE,
    s="""SELECT quantile_cont(treo_mean,0.5) m,
      quantile_cont(treo_mean,0.75)-quantile_cont(treo_mean,0.25) w,
      quantile_cont(elevation,0.5) m2,
      quantile_cont(elevation,0.75)-quantile_cont(elevation,0.25) w2 FROM hole
      WHERE treo_mean IS NOT NULL""",
))
def robust_scaling(spark, sf):
    rows = hole_table(spark, sf).filter("treo_mean IS NOT NULL")
    master = stage_table(rows.select("hole_id", "treo_mean", "elevation"), "robust")
    stats = cols.robust_statistics(master, ["treo_mean", "elevation"])
    return settled(cols.robust_scaled(master, stats), 5)
