"""Scans of the text sources. Schemas are declared; nothing is inferred in a job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from limnos.functions.nulls import MISSING_MARKERS, col, missing_to_null, nan_to_null

# Column names of the published water-quality tables.
MEASUREMENT_COLUMNS = {
    "monitoringSiteIdentifier": "string",
    "parameterWaterBodyCategory": "string",
    "observedPropertyDeterminandLabel": "string",
    "resultUom": "string",
    "phenomenonTimeSamplingDate": "string",
    "resultObservedValue": "double",
    "resultQualityObservedValueBelowLOQ": "boolean",
    "parameterSampleDepth": "double",
    "resultObservationStatus": "string",
}
AGGREGATED_COLUMNS = {
    "monitoringSiteIdentifier": "string",
    "parameterWaterBodyCategory": "string",
    "observedPropertyDeterminandLabel": "string",
    "resultUom": "string",
    "phenomenonTimeReferenceYear": "int",
    "parameterSamplingPeriod": "string",
    "procedureLOQValue": "double",
    "resultNumberOfSamples": "int",
    "resultQualityNumberOfSamplesBelowLOQ": "int",
    "resultQualityMinimumBelowLOQ": "boolean",
    "resultMinimumValue": "double",
    "resultQualityMeanBelowLOQ": "boolean",
    "resultMeanValue": "double",
    "resultQualityMaximumBelowLOQ": "boolean",
    "resultMaximumValue": "double",
    "resultQualityMedianBelowLOQ": "boolean",
    "resultMedianValue": "double",
    "resultStandardDeviationValue": "double",
    "parameterSampleDepth": "double",
    "metadata_observationStatus": "string",
}
SITE_COLUMNS = {
    "countryCode": "string",
    "monitoringSiteIdentifier": "string",
    "monitoringSiteIdentifierScheme": "string",
    "monitoringSiteName": "string",
    "waterBodyIdentifier": "string",
    "waterBodyIdentifierScheme": "string",
    "waterBodyName": "string",
    "specialisedZoneType": "string",
    "subUnitName": "string",
    "rbdIdentifier": "string",
    "rbdName": "string",
    "lon": "double",
    "lat": "double",
}


#: Header lines read side by side.
HEADERS_AT_ONCE = 8


def typed_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV by header name: text is normalised first, then cast; bad numbers become NULL.

    The files may hold more columns, or fewer, in any order. Only the header line of each file is read here; files with the same header
    are one scan, pruned to the declared columns, and the scans are put together by name. A declared column that a file lacks is NULL there.
    """
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]

    def header_of(file: str) -> tuple[str, ...]:
        return tuple(spark.read.csv(file, header=True).columns)

    with ThreadPool(HEADERS_AT_ONCE) as pool:
        found = pool.map(inheritable_thread_target(spark)(header_of), sorted(files))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(found, sorted(files)):
        by_header.setdefault(header, []).append(file)
    scans = [_typed_scan(spark, group, header, columns) for header, group in by_header.items()]
    return reduce(DataFrame.unionByName, scans)


def _typed_scan(spark: SparkSession, files: list[str], found: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """The declared columns of files with one header; a file with another header fails the scan."""
    raw = spark.read.schema(T.StructType([T.StructField(name, T.StringType()) for name in found]))
    header = [name.strip().lstrip("﻿") for name in found]
    df = raw.csv(files, header=True, enforceSchema=False).toDF(*header)
    out = []
    for name, kind in columns.items():
        c = missing_to_null(col(name)) if name in header else F.lit(None).cast("string")
        if kind != "string":
            c = c.try_cast(kind)
        out.append((nan_to_null(c) if kind == "double" else c).alias(name))
    return df.select(*out)


def scan_measurements(spark: SparkSession, path: str, date_format: str = "yyyyMMdd") -> DataFrame:
    """Disaggregated table, one row per sample result, with a parsed sampling date."""
    df = typed_csv(spark, path, MEASUREMENT_COLUMNS)
    when = F.try_to_timestamp("phenomenonTimeSamplingDate", F.lit(date_format)).cast("date")
    return df.withColumn("phenomenonTimeSamplingDate", when)


def scan_aggregated(spark: SparkSession, path: str) -> DataFrame:
    """Pre-aggregated table, one row per site, target, year, depth and period."""
    return typed_csv(spark, path, AGGREGATED_COLUMNS)


def scan_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site metadata."""
    return typed_csv(spark, path, SITE_COLUMNS)


def normalise_missing(df: DataFrame, markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    """Turn the missing-value markers into NULL in every text column."""
    markers = list(markers)
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[missing_to_null(col(c), markers).alias(c) if c in text else col(c)
                       for c in df.columns])


def rename_first_column(df: DataFrame, name: str) -> DataFrame:
    """Repair a first header damaged by a byte-order mark."""
    return df.toDF(name, *df.columns[1:])
