"""The measurement and site tables derived from the star-schema test tables.

The SQL text is valid in Spark and in DuckDB, so the oracles paste the same views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MEASUREMENTS_SQL = """
SELECT l.l_suppkey AS site_id,
  CASE l.l_suppkey % 5 WHEN 0 THEN 'GW' WHEN 1 THEN 'RW' WHEN 2 THEN 'LW' WHEN 3 THEN 'CW' ELSE 'TW' END AS wb_code,
  p.p_type AS target,
  CASE WHEN p.p_type = 'PROMO' AND l.l_linestatus = 'F' THEN 'mmol/L' ELSE 'mg/L' END AS uom,
  CAST(l.l_shipdate AS DATE) AS sampled_on,
  CASE WHEN l.l_linenumber = 7 AND l.l_partkey % 10 = 0 THEN NULL ELSE CAST(round(l.l_extendedprice * 100) AS DOUBLE) END AS value,
  l.l_discount <= CASE WHEN p.p_type = 'SMALL' THEN 0.055 ELSE 0.005 END AS below_loq,
  CASE WHEN l.l_linenumber = 1 THEN NULL ELSE l.l_linenumber END AS depth,
  CASE l.l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'U' ELSE NULL END AS status,
  concat_ws('-', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING),
    CAST(l.l_suppkey AS STRING), CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS STRING)) AS sample_id
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""

SITES_SQL = """
SELECT s.s_suppkey AS site_id, s.s_name AS site_name, n.n_name AS country, r.r_name AS rbd,
  CAST(6.0 + (s.s_suppkey % 40) / 10.0 AS DOUBLE) AS lon, CAST(46.0 + (s.s_suppkey % 18) / 10.0 AS DOUBLE) AS lat,
  'euMonitoringSiteCode' AS scheme
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
WHERE s.s_suppkey % 10 <> 9
UNION ALL
SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'eionetMonitoringSiteCode'
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
WHERE s.s_suppkey % 7 = 0
UNION ALL
SELECT NULL, NULL, n.n_name, r.r_name, CAST(7.0 AS DOUBLE), CAST(47.0 AS DOUBLE), 'euMonitoringSiteCode'
FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey < 3
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """site_id, wb_code, target, uom, sampled_on, value, below_loq, depth, status, sample_id."""
    return spark.sql(MEASUREMENTS_SQL, lineitem=table(spark, folder, "lineitem"),
                     part=table(spark, folder, "part"))


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """site_id (nullable, may repeat), site_name, country, rbd, lon, lat, scheme."""
    return spark.sql(SITES_SQL, **{t: table(spark, folder, t) for t in ("supplier", "nation", "region")})
