"""Projections and derived columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.nulls import col, extract_or_null, fill_null, ratio

# Water-body codes and their names.
WATER_BODY_NAMES = {
    "RW": "river",
    "GW": "ground",
    "CW": "coastal",
    "TeW": "territorial",
    "TW": "transitional",
    "LW": "lake",
}
SEASON_LETTERS = {"winter": "W", "summer": "S"}


def project_columns(df: DataFrame, columns: Sequence[str | int]) -> DataFrame:
    """Keep the listed columns, by name or by position."""
    return df.select(*[col(df.columns[c] if isinstance(c, int) else c) for c in columns])


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that are null in every row; one pass over the data."""
    filled = df.agg(*[F.count(col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[col(c) for c, n in zip(df.columns, filled) if n > 0])


def drop_columns_matching(df: DataFrame, pattern: str, keep: bool = False) -> DataFrame:
    """Drop (or only keep) the columns whose name matches a regular expression."""
    return df.select(*[col(c) for c in df.columns if bool(re.search(pattern, c)) == keep])


def select_prefix(df: DataFrame, prefixes: Sequence[str], keep: bool = True,
                  always: Sequence[str] = ()) -> DataFrame:
    """Keep (or drop) the columns with one of the prefixes; ``always`` stay in front."""
    chosen = [c for c in df.columns if c not in always and c.startswith(tuple(prefixes)) == keep]
    return df.select(*[col(c) for c in [*always, *chosen]])


def clean_name(name: str) -> str:
    """snake_case of a column name; ``pH`` becomes ``ph``."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    snake = re.sub(r"[^0-9a-z]+", "_", words.lower()).strip("_")
    return re.sub(r"(^|_)p_h(?=_|$)", r"\1ph", snake)


def clean_names(df: DataFrame) -> DataFrame:
    names: list[str] = []
    for c in map(clean_name, df.columns):
        same = sum(1 for n in names if n == c or re.fullmatch(re.escape(c) + r"_\d+", n))
        names.append(f"{c}_{same + 1}" if c in names else c)
    return df.toDF(*names)


def transmute_measurements(df: DataFrame) -> DataFrame:
    """Site, water-body and target vocabulary of the analysis; text numbers become numbers or null."""
    return df.select(
        col("site_id").cast("string").alias("site"),
        col("wb_code").alias("WB_type"),
        col("target").alias("AT_name"),
        col("sampled_on").alias("meas_date"),
        F.year("sampled_on").alias("meas_year"),
        col("value").try_cast("double").alias("measured_value"),
        col("uom").alias("measured_value_unit"),
        col("below_loq").try_cast("boolean").alias("below_LOQ"),
    )


def recode_categories(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace codes by names; codes without a name stay."""
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(column, F.coalesce(F.try_element_at(names, col(column)), col(column)))


def season_of(month: Column) -> Column:
    """April to September is summer; a missing month has no season."""
    return F.when(month.between(4, 9), "summer").when(month.isNotNull(), "winter")


def derive_period(df: DataFrame, date_column: str, missing_is_summer: bool = False) -> DataFrame:
    """Add year, month and season. ``missing_is_summer`` puts undated rows into summer."""
    month = F.month(col(date_column))
    season = season_of(month)
    if missing_is_summer:
        season = F.coalesce(season, F.lit("summer"))
    return (df.withColumn("year", F.year(col(date_column))).withColumn("month", month)
            .withColumn("season", season))


def below_loq_ratio(df: DataFrame, below: str, samples: str) -> DataFrame:
    """A missing below-LOQ count is 0; then the share 0..1 of samples below LOQ."""
    known = F.coalesce(col(below), F.lit(0))
    return df.withColumn(below, known).withColumn("below_loq_ratio", ratio(col(below), col(samples)))


def composite_key(df: DataFrame, parts: Sequence[Column], out: str, separator: str = "-") -> DataFrame:
    """Readable identifier; missing as soon as one part is missing."""
    pieces: list[Column] = []
    for p in parts:
        pieces += [F.lit(separator), p.cast("string")]
    return df.withColumn(out, F.concat(*pieces[1:]))


def observation_key(df: DataFrame, site: str, wb: str, period: str | None = None,
                    out: str = "obs_id") -> DataFrame:
    """``[period-]<first letter of the water body>-<number at the end of the site>``."""
    parts = [extract_or_null(col(wb), "^[A-Za-z]"), extract_or_null(col(site), "[0-9]{2,4}[A-Za-z]*$")]
    return composite_key(df, ([col(period)] if period else []) + parts, out)


def wgs84_to_lv95(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Swiss LV95 metres from degrees, by the published approximation polynomial."""
    a = (col(lon) * 3600 - 26782.5) / 10000
    b = (col(lat) * 3600 - 169028.66) / 10000
    # Coefficients of the polynomial.
    east = (2600072.37 + 211455.93 * a - 10938.51 * a * b - 0.36 * a * b * b - 44.54 * a * a * a)
    north = (1200147.07 + 308807.95 * b + 3745.25 * a * a + 76.63 * b * b - 194.56 * a * a * b
             + 119.79 * b * b * b)
    return df.withColumn("east", east).withColumn("north", north)


def lv03_shift(df: DataFrame, east: str = "east", north: str = "north", to_lv95: bool = False) -> DataFrame:
    """Move between LV95 and the older LV03 frame (metre accuracy)."""
    sign = 1 if to_lv95 else -1
    return (df.withColumn(east, col(east) + sign * 2_000_000.0)
            .withColumn(north, col(north) + sign * 1_000_000.0))


def fill_constant(df: DataFrame, columns: Sequence[str], value: float | str | bool) -> DataFrame:
    return fill_null(df, columns, value)


def row_totals_and_shares(df: DataFrame, count_columns: Sequence[str], below_columns: Sequence[str] = (),
                          total: str = "total") -> DataFrame:
    """Row-wise total of a column family, each column's share of it, and the overall share below LOQ."""
    def row_sum(names: Sequence[str]) -> Column:
        return sum((F.coalesce(col(c), F.lit(0)) for c in names), F.lit(0).cast("long"))

    out = df.withColumn(total, row_sum(count_columns))
    for c in count_columns:
        out = out.withColumn(f"{c}_share", ratio(col(c), col(total)))
    if below_columns:
        out = out.withColumn("below_loq_ratio", ratio(row_sum(below_columns), col(total)))
    return out
