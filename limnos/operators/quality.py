"""Data-quality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limnos.functions.nulls import col, percent, unpivot_columns


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, rows, nulls, percentage null and distinct values.

    The counts of all columns take one pass. Exact distinct counts go through (column, value) pairs
    that are combined before the shuffle; ``approximate`` uses sketches in the first pass instead.
    """
    names = df.columns
    measures = [F.count(F.lit(1)).alias("rows")] + [F.count(col(c)).alias(f"n_{i}") for i, c in enumerate(names)]
    if approximate:
        measures += [F.approx_count_distinct(col(c)).alias(f"d_{i}") for i, c in enumerate(names)]
    one = df.agg(*measures)
    lines = F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col("rows").alias("n_rows"),
        (F.col("rows") - F.col(f"n_{i}")).alias("n_null"),
        (F.col(f"d_{i}") if approximate else F.lit(None).cast("long")).alias("n_distinct"))
        for i, (c, kind) in enumerate(df.dtypes)])
    profile = one.select(F.inline(lines))
    if not approximate:
        text = df.select(*[col(c).cast("string").alias(c) for c in names])
        pairs = unpivot_columns(text, [], names, "column", "value").dropna(subset=["value"]).distinct()
        distinct = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
        profile = (profile.drop("n_distinct").join(distinct, "column", "left")
                   .fillna(0, ["n_distinct"]))
    return profile.withColumn("null_pct", percent(F.col("n_null"), F.col("n_rows")))
