"""Filters; all of them are predicates Catalyst pushes to the scan where it can."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from limnos.functions.nulls import col, drop_null_rows

# The general and the metal target groups.
TARGET_GROUPS = {
    "general": ("pH", "Water Temperature", "Oxygen saturation", "Electrical conductivity", "Ammonium",
                "Phosphate", "Nitrate", "BOD5"),
    "metals": ("Lead and its compounds", "Copper and its compounds", "Cadmium and its compounds",
               "Zinc and its compounds", "Nickel and its compounds", "Arsenic and its compounds",
               "Mercury and its compounds", "Chromium and its compounds", "Iron and its compounds"),
}


def filter_target_group(df: DataFrame, group: str, groups: Mapping[str, Sequence[str]] = TARGET_GROUPS) -> DataFrame:
    """Rows of the targets of a named group."""
    return df.where(col("target").isin(*groups[group]))


def filter_target(df: DataFrame, target: str, wb: str | None = None,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of one target, optionally of one water-body type, projected."""
    out = df.where(col("target") == target)
    if wb is not None:
        out = out.where(col("wb_code") == wb)
    return out.select(*[col(c) for c in columns]) if columns else out


def filter_quantified(df: DataFrame, flag: str = "below_loq") -> DataFrame:
    """Values above LOQ; the flag may be boolean or the text True/False."""
    return df.where(~col(flag).try_cast("boolean"))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return drop_null_rows(df, columns)


def filter_false_or_null(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Keep rows on which every flag is false or unknown."""
    for flag in flags:
        df = df.where(~F.coalesce(col(flag), F.lit(False)))
    return df


def filter_status(df: DataFrame, column: str = "status", normal: str = "A") -> DataFrame:
    """Keep rows with the normal status or none."""
    return df.where(col(column).isNull() | (col(column) == normal))


def filter_thresholds(df: DataFrame, max_below_loq_pct: float | None = None, min_samples: int | None = None,
                      below: str = "below_loq_pct", samples: str = "n") -> DataFrame:
    """Keep groups with less than a share below LOQ and more than a number of samples."""
    if max_below_loq_pct is not None:
        df = df.where(col(below) < float(max_below_loq_pct))
    if min_samples is not None:
        df = df.where(col(samples) > min_samples)
    return df


def filter_in_list(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Keep rows whose value is listed. The list is cast to the type of the column; what cannot be cast matches nothing."""
    kind = df.schema[column].dataType
    return df.where(col(column).isin([F.lit(v).try_cast(kind) for v in values]))


def filter_years(df: DataFrame, first: int | None = None, last: int | None = None,
                 years: Sequence[int] = (), country: str | None = None, wb: str | None = None) -> DataFrame:
    """Year range or list, combined with country and water-body type."""
    if first is not None:
        df = df.where(col("year") >= first)
    if last is not None:
        df = df.where(col("year") <= last)
    if years:
        df = df.where(col("year").isin(list(years)))
    if country is not None:
        df = df.where(col("country") == country)
    return df.where(col("wb_code") == wb) if wb is not None else df


def complete_cases(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows with a null in ``any`` (or in ``all``) of the columns."""
    return drop_null_rows(df, columns, how)


def loq_classes(df: DataFrame, ratio_column: str = "below_loq_ratio", loq_column: str = "loq_value") -> DataFrame:
    """Class a row by its share below LOQ, and flag rows without an LOQ value."""
    r = col(ratio_column)
    return (df.withColumn("loq_class", F.when(r == 1, "always_below").when(r == 0, "always_above")
                          .when((r > 0) & (r < 1), "mixed"))
            .withColumn("no_loq_value", col(loq_column).isNull()))
