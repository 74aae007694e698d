"""Null and number rules shared by all operators.

Missing values are NULL everywhere: NaN is turned into NULL on entry, because Spark orders
NaN above every number and it would pass a ``>`` filter.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# The text markers read as missing.
MISSING_MARKERS = ("", " ", "NA", "N/A")


def quoted(name: str) -> str:
    """Exact column name for Spark calls that parse names; targets may hold dots and blanks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def drop_null_rows(df: DataFrame, columns: Iterable[str], how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=[quoted(c) for c in columns])


def fill_null(df: DataFrame, columns: Iterable[str], value: float | str | bool) -> DataFrame:
    return df.fillna(value, [quoted(c) for c in columns])


def unpivot_columns(df: DataFrame, ids: Iterable[str], columns: Iterable[str], name: str, value: str) -> DataFrame:
    return df.unpivot([col(c) for c in ids], [col(c) for c in columns], name, value)


def missing_to_null(c: Column, markers: Iterable[str] = MISSING_MARKERS) -> Column:
    return F.when(~c.isin(*markers), c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is NULL, not an error, for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part.cast("double") * F.lit(100.0), whole)


def mean_if_complete(c: Column) -> Column:
    """Mean which is missing as soon as one input is missing."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def stddev_if_complete(c: Column) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(c), F.stddev_samp(c))


def distinct_with_null(c: Column) -> Column:
    """Distinct count in which NULL is one more value."""
    return F.count_distinct(c) + F.max(F.when(c.isNull(), F.lit(1)).otherwise(F.lit(0)))


def extract_or_null(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def keys_not_null(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Drop rows whose grouping key is missing."""
    return drop_null_rows(df, keys)


def one_row(df: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery; no join and no collect."""
    return df.select(F.struct(*[col(c) for c in df.columns])).scalar()
