"""Exploration inputs as views over the provided parquet tables.

Each text is valid in Spark SQL and in ANSI engines; ``{name}`` marks a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "collar": """
SELECT CAST(c_custkey AS STRING) AS hole_id,
  CONCAT('d', CAST(c_nationkey % 5 AS STRING)) AS deposit,
  CASE WHEN c_custkey % 97 = 0 THEN NULL
       ELSE 122.5e0 + (c_custkey*7919 % 1000)/10000e0 END AS lon,
  CASE WHEN c_custkey % 97 = 0 THEN NULL
       ELSE -28.9e0 + (c_custkey*6367 % 1000)/10000e0 END AS lat,
  c_acctbal AS elevation, (c_custkey % 300)*1e0 AS maxdepth
FROM {customer}""",
    "assay": """
SELECT CAST(o_custkey AS STRING) AS hole_id, l_orderkey AS sample_id,
  l_linenumber*10e0 AS fromdepth, l_linenumber*10e0 + l_quantity AS todepth,
  CASE WHEN l_linestatus='O' OR (l_orderkey+l_linenumber) % 17 = 0 THEN NULL
       ELSE l_extendedprice/10e0 END AS ceo2_ppm,
  CASE WHEN l_returnflag='A' OR (l_orderkey+l_linenumber) % 17 = 0 THEN NULL
       ELSE l_quantity*20e0 END AS la2o3_ppm,
  CASE WHEN (l_linestatus='O' AND l_returnflag='A')
         OR (l_orderkey+l_linenumber) % 17 = 0 THEN NULL
       ELSE l_discount*10000e0 END AS nd2o3_ppm,
  CASE WHEN l_returnflag='R' OR (l_orderkey+l_linenumber) % 17 = 0 THEN NULL
       ELSE l_tax*5000e0 END AS dy2o3_ppm,
  l_quantity*100e0 AS fe2o3_ppm, l_tax*1000e0 AS p2o5_ppm,
  l_discount*500e0 AS tho2_ppm, l_tax*50e0 AS u3o8_ppm
FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey
WHERE o_custkey % 10 <> 3""",
    "assay_long": """
SELECT CAST(user_id AS STRING) AS hole_id, event_type AS attributecolumn,
  CASE WHEN event_id % 50 = 0 THEN '<0.5' WHEN event_id % 71 = 0 THEN NULL
       ELSE CAST(value AS STRING) END AS attributevalue
FROM {events}""",
    "alteration": """
SELECT CAST(user_id AS STRING) AS hole_id,
  CASE event_id % 7 WHEN 0 THEN 'Lateritic CLAY' WHEN 1 THEN 'weathered carbonatite'
    WHEN 2 THEN 'goethite/limonite' WHEN 3 THEN 'Saprolite, oxidised'
    WHEN 4 THEN 'fresh' WHEN 5 THEN 'ferruginous cap' END AS attributevalue
FROM {events}""",
    "pixels": """
SELECT 'tmi' AS raster_id, CAST(floor(p_partkey/40e0) AS INT) AS prow,
  CAST(p_partkey % 40 AS INT) AS pcol,
  CASE WHEN p_size=1 THEN -9999e0 ELSE p_retailprice END AS val
FROM {part}""",
    "polygons": """
SELECT n_nationkey AS poly_id, n_name AS unit_name,
  122.5e0+0.02e0*(n_nationkey % 5) AS xmin, 122.525e0+0.02e0*(n_nationkey % 5) AS xmax,
  -28.9e0+0.02e0*floor(n_nationkey/5e0) AS ymin,
  -28.88e0+0.02e0*floor(n_nationkey/5e0) AS ymax
FROM {nation}""",
    "bands": """
SELECT c_custkey AS point_id, (c_custkey*31 % 200)*1e0 AS blue,
  (c_custkey*37 % 211)*1e0 AS green, (c_custkey*41 % 223)*1e0 AS red,
  (c_custkey*43 % 227)*1e0 AS nir, (c_custkey*47 % 229)*1e0 AS swir1,
  (c_custkey*53 % 7)*1e0 AS swir2
FROM {customer}""",
    "preds": """
SELECT doc_id AS row_id, quality AS label, (doc_id*37 % 101)/100e0 AS score
FROM {labels}""",
    "registry": """
SELECT CONCAT('d', CAST(s_nationkey % 5 AS STRING)) AS deposit, s_suppkey AS version,
  s_suppkey*10 AS n_holes, round(s_acctbal/10000e0,4) AS cv_r2
FROM {supplier}""",
    # Predictions of three models against a label, one row per order.
    "model_preds": """
SELECT o_orderkey AS row_id, (o_totalprice % 1000)/1000e0 AS y,
  (o_totalprice % 1000)/2000e0 + (o_orderkey*37 % 101)/400e0 AS p_gb,
  (o_totalprice % 1000)/1500e0 + (o_orderkey*53 % 97)/600e0 AS p_lin,
  (o_totalprice % 1000)/1200e0 + (o_orderkey*71 % 89)/900e0 AS p_rf
FROM {orders}""",
    # A file listing: path, size, modification time and header line.
    "files": """
SELECT CONCAT('/data/',
    CASE p_partkey % 6 WHEN 0 THEN 'Mount Weld' WHEN 1 THEN 'mountain-pass'
      WHEN 2 THEN 'Bayan' WHEN 3 THEN 'new prospect' WHEN 4 THEN 'br_east'
      ELSE 'reserve' END, '/',
    CASE p_partkey % 13 WHEN 0 THEN 'dh_collar' WHEN 1 THEN 'dh_assay_pivoted'
      WHEN 2 THEN 'TMI-grid' WHEN 3 THEN 'LC09_L2SP_B4.' WHEN 4 THEN 'geology units'
      WHEN 5 THEN 'dem_10m' WHEN 6 THEN 'soil_lines' WHEN 7 THEN 'notes'
      WHEN 8 THEN 'T51JVJ_B04_10m' WHEN 9 THEN 'dh_alteration'
      WHEN 10 THEN 'gravity 2019' WHEN 11 THEN 'm2_regional_k'
      ELSE 'dh_geochem' END, CAST(p_partkey AS STRING),
    CASE p_size % 12 WHEN 0 THEN '.csv' WHEN 1 THEN '.TIF' WHEN 2 THEN '.txt'
      WHEN 3 THEN '.geojson' WHEN 4 THEN '.asc' WHEN 5 THEN '.zip' WHEN 6 THEN '.json'
      WHEN 7 THEN '.jp2' WHEN 8 THEN '.csv' WHEN 9 THEN '.img' WHEN 10 THEN '.xyz'
      ELSE '.pdf' END) AS path,
  CAST(floor(p_retailprice*p_size*1009) AS BIGINT) AS length,
  p_partkey*7919 % 86400 AS mtime,
  CASE p_partkey % 5 WHEN 0 THEN 'HoleID,Easting,Northing,MaxDepth'
    WHEN 1 THEN 'companyholeid, FromDepth ,ToDepth,CeO2_ppm,La2O3_ppm'
    WHEN 2 THEN 'sample_id,Au,Cu,lab' WHEN 3 THEN 'unit,age,description'
    ELSE 'x,y,elevation' END AS header
FROM {part}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One exploration input as a DataFrame; nothing is read yet."""
    text = VIEWS[name]
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def view_sql(name: str) -> str:
    """The same input as plain SQL over the base tables."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]).strip()
