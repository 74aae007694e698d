"""2.1 Sources and sinks. Text copies of the tables are written to the shared folder first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limnos.catalog.registry import aggregated, derived, meas, query, sites
from limnos.functions.nulls import col
from limnos.session import shared_folder
from limnos.sources import readers, staging


def csv_copy(spark: SparkSession, name: str, folder: str) -> str:
    """Text copy of a table."""
    return derived(spark, f"{name}.csv", folder, lambda path: staging.export_csv(SOURCES[name](spark, folder), path))


def _measurement_text(spark: SparkSession, folder: str) -> DataFrame:
    m = meas(spark, folder)
    return m.select(
        col("site_id").alias("monitoringSiteIdentifier"), col("wb_code").alias("parameterWaterBodyCategory"),
        col("target").alias("observedPropertyDeterminandLabel"), col("uom").alias("resultUom"),
        F.date_format("sampled_on", "yyyyMMdd").alias("phenomenonTimeSamplingDate"),
        col("value").cast("decimal(20,0)").alias("resultObservedValue"),
        col("below_loq").alias("resultQualityObservedValueBelowLOQ"), col("depth").alias("parameterSampleDepth"),
        col("status").alias("resultObservationStatus"), col("sample_id").alias("sampleIdentifier"))


def _aggregated_text(spark: SparkSession, folder: str) -> DataFrame:
    m = meas(spark, folder)
    return m.groupBy("site_id", "wb_code", "target", F.year("sampled_on").alias("y")).agg(
        F.count("value").alias("n"), F.sum(col("below_loq").cast("int")).alias("below"),
        F.min("value").cast("decimal(20,0)").alias("lo"), F.max("value").cast("decimal(20,0)").alias("hi"),
        F.max("below_loq").alias("flag")).select(
        col("site_id").alias("monitoringSiteIdentifier"), col("wb_code").alias("parameterWaterBodyCategory"),
        col("target").alias("observedPropertyDeterminandLabel"), F.lit("mg/L").alias("resultUom"),
        col("y").alias("phenomenonTimeReferenceYear"), F.lit("N/A").alias("parameterSamplingPeriod"),
        col("n").alias("resultNumberOfSamples"), col("below").alias("resultQualityNumberOfSamplesBelowLOQ"),
        col("lo").alias("resultMinimumValue"), col("hi").alias("resultMaximumValue"),
        col("flag").alias("resultQualityMaximumBelowLOQ"), F.lit("A").alias("metadata_observationStatus"))


def _site_text(spark: SparkSession, folder: str) -> DataFrame:
    s = sites(spark, folder)
    return s.select(
        col("country").alias("countryCode"), col("site_id").alias("monitoringSiteIdentifier"),
        col("scheme").alias("monitoringSiteIdentifierScheme"), col("site_name").alias("monitoringSiteName"),
        col("rbd").alias("rbdName"), col("lon").cast("decimal(6,1)").alias("lon"), col("lat").cast("decimal(6,1)").alias("lat"))


SOURCES = {"measurements": _measurement_text, "aggregated": _aggregated_text, "sites": _site_text}


@query("scan_measurements", """
SELECT CAST(site_id AS VARCHAR) AS site, wb_code AS wb, target, uom, CAST(sampled_on AS VARCHAR) AS sampled_on,
  R(value) AS value, below_loq, R(depth) AS depth, status FROM m""")
def scan_measurements(spark, folder):
    df = readers.scan_measurements(spark, csv_copy(spark, "measurements", folder))
    return df.select(
        col("monitoringSiteIdentifier").alias("site"), col("parameterWaterBodyCategory").alias("wb"),
        col("observedPropertyDeterminandLabel").alias("target"), col("resultUom").alias("uom"),
        col("phenomenonTimeSamplingDate").cast("string").alias("sampled_on"), col("resultObservedValue").alias("value"),
        col("resultQualityObservedValueBelowLOQ").alias("below_loq"), col("parameterSampleDepth").alias("depth"),
        col("resultObservationStatus").alias("status"))


@query("scan_aggregated", """
SELECT CAST(site_id AS VARCHAR) AS site, target, CAST(year(sampled_on) AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS period,
  CAST(count(value) AS INTEGER) AS n, CAST(sum(CASE WHEN below_loq THEN 1 ELSE 0 END) AS INTEGER) AS n_below,
  R(min(value)) AS lo, R(max(value)) AS hi, bool_or(below_loq) AS flag FROM m
GROUP BY site_id, wb_code, target, year(sampled_on)""")
def scan_aggregated(spark, folder):
    df = readers.scan_aggregated(spark, csv_copy(spark, "aggregated", folder))
    return df.select(
        col("monitoringSiteIdentifier").alias("site"), col("observedPropertyDeterminandLabel").alias("target"),
        col("phenomenonTimeReferenceYear").alias("year"), col("parameterSamplingPeriod").alias("period"),
        col("resultNumberOfSamples").alias("n"), col("resultQualityNumberOfSamplesBelowLOQ").alias("n_below"),
        col("resultMinimumValue").alias("lo"), col("resultMaximumValue").alias("hi"),
        col("resultQualityMaximumBelowLOQ").alias("flag"))


@query("scan_sites", """
SELECT country, CAST(site_id AS VARCHAR) AS site, scheme, site_name, rbd, R(lon) AS lon, R(lat) AS lat FROM st""")
def scan_sites(spark, folder):
    df = readers.scan_sites(spark, csv_copy(spark, "sites", folder))
    return df.select(
        col("countryCode").alias("country"), col("monitoringSiteIdentifier").alias("site"),
        col("monitoringSiteIdentifierScheme").alias("scheme"), col("monitoringSiteName").alias("site_name"),
        col("rbdName").alias("rbd"), "lon", "lat")


@query("normalise_missing", """
SELECT site_id, CASE WHEN target = 'PROMO' THEN NULL ELSE target END AS target,
  CASE WHEN status IS NULL OR status = 'U' THEN NULL ELSE status END AS status,
  CASE WHEN wb_code = 'GW' THEN NULL ELSE wb_code END AS wb_code FROM m""")
def normalise_missing(spark, folder):
    marked = meas(spark, folder).select(
        "site_id", F.when(col("target") == "PROMO", "N/A").otherwise(col("target")).alias("target"),
        F.when(col("status") == "U", " ").otherwise(F.coalesce(col("status"), F.lit(""))).alias("status"),
        F.when(col("wb_code") == "GW", "NA").otherwise(col("wb_code")).alias("wb_code"))
    return readers.normalise_missing(marked)


@query("rename_first_column", "SELECT site_id AS monitoringSiteIdentifier, target, value FROM m")
def rename_first_column(spark, folder):
    damaged = meas(spark, folder).select("site_id", "target", "value").withColumnRenamed("site_id", "ï..site_id")
    return readers.rename_first_column(damaged, "monitoringSiteIdentifier")


@query("stage_tables", "SELECT site_id, target, year, n, R(mean) AS mean, below_loq_sum FROM ay")
def stage_tables(spark, folder):
    table = aggregated(spark, folder, "site_id", "target", "year").select("site_id", "target", "year", "n", "mean", "below_loq_sum")
    return staging.stage_table(table, shared_folder(spark, "aggregates"), ["target"])


@query("export_csv", "SELECT wb_code, target, n, below_loq_sum FROM aw")
def export_csv(spark, folder):
    table = aggregated(spark, folder, "wb_code", "target").select("wb_code", "target", "n", "below_loq_sum")
    path = staging.export_csv(table, shared_folder(spark, "export"))
    return spark.read.schema("wb_code string, target string, n long, below_loq_sum long").csv(path, header=True)
