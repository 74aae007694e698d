"""Staged and exported tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def stage_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage as Parquet and go on from the written table, which also cuts the lineage."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)


def export_csv(df: DataFrame, path: str) -> str:
    """Write a table as CSV with a header; nulls are empty fields."""
    df.write.mode("overwrite").csv(path, header=True, emptyValue='""')
    return path
