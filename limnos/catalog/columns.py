"""2.2 Projections and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.catalog.registry import TARGETS, aggregated, meas, merged, query, sites
from limnos.functions.nulls import col
from limnos.operators import columns as op
from limnos.operators.joins import priority_dedupe_sites
from limnos.operators.reshape import count_matrix, pivot_multi


@query("project_columns", "SELECT site_id, target, value FROM m")
def project_columns(spark, folder):
    return op.project_columns(meas(spark, folder), [0, "target", "value"])


@query("drop_columns", "SELECT site_id, wb_code, target, CAST(sampled_on AS VARCHAR) AS day, value, below_loq FROM m")
def drop_columns(spark, folder):
    df = meas(spark, folder).withColumn("day", col("sampled_on").cast("string"))
    return op.drop_columns(df, ["uom", "depth", "status", "sample_id", "sampled_on"])


@query("drop_empty_columns", "SELECT site_id, target, value FROM m")
def drop_empty_columns(spark, folder):
    df = meas(spark, folder).select("site_id", "target", "value", F.lit(None).cast("string").alias("lipid"),
                                    F.when(col("site_id") < 0, 1.0).alias("moisture"))
    return op.drop_empty_columns(df)


@query("drop_columns_matching", """
SELECT wb_code, count(value) FILTER (target = 'ECONOMY') AS Economy, count(value) FILTER (target = 'PROMO') AS Promo
FROM me GROUP BY wb_code""")
def drop_columns_matching(spark, folder):
    m = merged(spark, folder)
    wide = m.groupBy("wb_code").agg(*[F.count(F.when(col("target") == t, col("value"))).alias(n) for t, n in (
        ("ECONOMY", "Economy"), ("PROMO", "Promo"), ("LARGE", "Large and its compounds"), ("SMALL", "Other small"))])
    return op.drop_columns_matching(wide, "^((?!compounds|Other).)*$", keep=True)


def _cells(exprs, targets=TARGETS):
    """FILTER list: <stat>_<target> columns from single-row cells."""
    return ", ".join(f'{e.format(t=t)} AS "{n}_{t}"' for n, e in exprs.items() for t in targets)


@query("select_prefix", f"""
SELECT site_id, {_cells({'n': "max(n) FILTER (target = '{t}')"})} FROM ag GROUP BY site_id""")
def select_prefix(spark, folder):
    wide = pivot_multi(aggregated(spark, folder, "site_id", "target"), ["site_id"], ["mean", "n", "sd"], TARGETS)
    return op.select_prefix(wide, ["n_"], always=["site_id"])


@query("clean_names", "SELECT site_id AS monitoring_site_identifier, R(value) AS result_observed_value_mean_ph, below_loq AS below_loq FROM m")
def clean_names(spark, folder):
    return op.clean_names(meas(spark, folder).select(
        col("site_id").alias("monitoringSiteIdentifier"), col("value").alias("resultObservedValue_mean_pH"),
        col("below_loq").alias("belowLOQ")))


@query("transmute_measurements", """
SELECT CAST(site_id AS VARCHAR) AS site, wb_code AS WB_type, target AS AT_name, CAST(sampled_on AS VARCHAR) AS meas_date,
  CAST(year(sampled_on) AS INTEGER) AS meas_year, R(value) AS measured_value, uom AS measured_value_unit,
  below_loq AS below_LOQ FROM m""")
def transmute_measurements(spark, folder):
    text = (meas(spark, folder).withColumn("value", F.coalesce(col("value").cast("string"), F.lit("n.d.")))
            .withColumn("below_loq", F.initcap(col("below_loq").cast("string"))))
    return op.transmute_measurements(text).withColumn("meas_date", col("meas_date").cast("string"))


@query("recode_categories", """
SELECT site_id, CASE wb_code WHEN 'RW' THEN 'river' WHEN 'GW' THEN 'ground' WHEN 'CW' THEN 'coastal'
  WHEN 'TeW' THEN 'territorial' WHEN 'TW' THEN 'transitional' WHEN 'LW' THEN 'lake' ELSE wb_code END AS wb_code,
  CASE season WHEN 'winter' THEN 'W' WHEN 'summer' THEN 'S' END AS season FROM mp""")
def recode_categories(spark, folder):
    df = op.derive_period(meas(spark, folder), "sampled_on").select("site_id", "wb_code", "season")
    return op.recode_categories(op.recode_categories(df, "wb_code", op.WATER_BODY_NAMES), "season", op.SEASON_LETTERS)


@query("derive_period", "SELECT site_id, CAST(sampled_on AS VARCHAR) AS sampled_on, year, month, season FROM mp")
def derive_period(spark, folder):
    df = op.derive_period(meas(spark, folder).select("site_id", "sampled_on"), "sampled_on")
    return df.withColumn("sampled_on", col("sampled_on").cast("string"))


@query("below_loq_ratio", """
SELECT site_id, target, year, n, coalesce(nullif(below_loq_sum, 0), 0) AS below_loq_sum,
  R(coalesce(nullif(below_loq_sum, 0), 0) / CAST(nullif(n, 0) AS DOUBLE)) AS below_loq_ratio FROM ay""")
def below_loq_ratio(spark, folder):
    agg = aggregated(spark, folder, "site_id", "target", "year").select("site_id", "target", "year", "n", "below_loq_sum")
    gaps = agg.withColumn("below_loq_sum", F.nullif("below_loq_sum", F.lit(0)))
    return op.below_loq_ratio(gaps, "below_loq_sum", "n")


@query("composite_key", """
SELECT DISTINCT CAST(site_id AS VARCHAR) || '_' || target || '_' || CAST(year AS VARCHAR) AS row_id,
  CASE season WHEN 'winter' THEN 'W' WHEN 'summer' THEN 'S' END || '-' || substr(wb_code, 1, 1) || '-'
  || nullif(regexp_extract('Site' || lpad(CAST(site_id AS VARCHAR), 4, '0'), '[0-9]{2,4}[A-Za-z]*$'), '') AS obs_id FROM me""")
def composite_key(spark, folder):
    df = op.recode_categories(merged(spark, folder), "season", op.SEASON_LETTERS)
    df = op.composite_key(df, [col("site_id"), col("target"), col("year")], "row_id", "_")
    df = df.withColumn("site_code", F.concat(F.lit("Site"), F.lpad(col("site_id").cast("string"), 4, "0")))
    return op.observation_key(df, "site_code", "wb_code", "season").select("row_id", "obs_id").distinct()


_LV95 = """SELECT *, 2600072.37 + 211455.93*a - 10938.51*a*b - 0.36*a*b*b - 44.54*a*a*a AS east,
  1200147.07 + 308807.95*b + 3745.25*a*a + 76.63*b*b - 194.56*a*a*b + 119.79*b*b*b AS north
  FROM (SELECT site_id, (lon*3600 - CAST(26782.5 AS DOUBLE))/10000 AS a, (lat*3600 - CAST(169028.66 AS DOUBLE))/10000 AS b FROM sd)"""


@query("wgs84_to_lv95", f"SELECT site_id, R(east) AS east, R(north) AS north FROM ({_LV95})", digits=2)
def wgs84_to_lv95(spark, folder):
    return op.wgs84_to_lv95(priority_dedupe_sites(sites(spark, folder)), "lon", "lat").select("site_id", "east", "north")


@query("lv03_shift", f"SELECT site_id, R(east - 2000000) AS east, R(north - 1000000) AS north FROM ({_LV95})", digits=2)
def lv03_shift(spark, folder):
    located = op.wgs84_to_lv95(priority_dedupe_sites(sites(spark, folder)), "lon", "lat")
    return op.lv03_shift(located).select("site_id", "east", "north")


@query("fill_constant", "SELECT site_id, target, coalesce(value, 0) AS value, coalesce(status, 'none') AS status FROM m")
def fill_constant(spark, folder):
    df = meas(spark, folder).select("site_id", "target", "value", "status")
    return op.fill_constant(op.fill_constant(df, ["value"], 0.0), ["status"], "none")


@query("row_totals_and_shares", f"""
SELECT *, {", ".join(f'R("{t}" / CAST(nullif(total, 0) AS DOUBLE)) AS "{t}_share"' for t in TARGETS)}
FROM (SELECT site_id, {", ".join(f"count(n) FILTER (target = '{t}') AS {t}" for t in TARGETS)}, count(n) AS total
      FROM ay GROUP BY site_id)""")
def row_totals_and_shares(spark, folder):
    wide = count_matrix(aggregated(spark, folder, "site_id", "target", "year"), TARGETS).fillna(0)
    return op.row_totals_and_shares(wide, TARGETS)
