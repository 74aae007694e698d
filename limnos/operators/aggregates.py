"""Aggregations. All of them combine partially before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from limnos.functions.nulls import (col, fill_null, distinct_with_null, keys_not_null, mean_if_complete,
                                    one_row, percent, ratio, stddev_if_complete, unpivot_columns)
from limnos.functions.selection import order_statistics, quantiles
from limnos.operators.joins import join_null_safe
from limnos.session import staged


def group_stats(meas: DataFrame, groups: Sequence[str], value: str = "value",
                flag: str = "below_loq") -> DataFrame:
    """Per group: count, mean and sd of the value, rows below LOQ and their percentage.

    Rows with a missing key are dropped. The percentage relates flags to non-null values.
    """
    return (keys_not_null(meas, groups).groupBy(*groups)
            .agg(F.count(col(value)).alias("n"), F.avg(col(value)).alias("mean"),
                 F.stddev_samp(col(value)).alias("sd"), F.sum(col(flag).cast("long")).alias("below_loq_sum"))
            .withColumn("below_loq_pct", percent(F.col("below_loq_sum"), F.col("n"))))


def aggregate_stats(meas: DataFrame, groups: Sequence[str], value: str = "value",
                    flag: str = "below_loq") -> DataFrame:
    """``group_stats``, busiest group first; for reports, where the order matters."""
    return group_stats(meas, groups, value, flag).orderBy(F.desc("n"), *groups)


def aggregate_moments(meas: DataFrame, groups: Sequence[str], value: str = "value",
                      flag: str = "below_loq") -> DataFrame:
    """The finest grain once, as mergeable parts: n, mean, centred sum of squares, rows below LOQ."""
    return (keys_not_null(meas, groups).groupBy(*groups)
            .agg(F.count(col(value)).alias("n"), F.avg(col(value)).alias("mean"),
                 (F.var_pop(col(value)) * F.count(col(value))).alias("m2"),
                 F.sum(col(flag).cast("long")).alias("below_loq_sum")))


def roll_up_stats(moments: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``aggregate_stats`` at a coarser grain from ``aggregate_moments``.

    Merges means and centred squares, so no digits are lost and the raw rows are read only once. The
    spread of the part means comes from their variance, weighted by a second small aggregate.
    """
    n, mean = F.col("n"), F.col("mean")
    grand = (moments.groupBy(*groups)
             .agg(F.sum("n").alias("g_n"), ratio(F.sum(mean * n), F.sum("n")).alias("g_mean")))
    merged = (moments.join(grand, list(groups))
              .groupBy(*groups)
              .agg(F.first("g_n").alias("n"), F.first("g_mean").alias("mean"),
                   F.sum(F.col("m2") + n * F.pow(mean - F.col("g_mean"), F.lit(2.0))).alias("m2"),
                   F.sum("below_loq_sum").alias("below_loq_sum")))
    return merged.select(
        *groups, "n", "mean",
        F.when(n > 1, F.sqrt(F.col("m2") / F.nullif(n - 1, F.lit(0)))).alias("sd"),
        "below_loq_sum", percent(F.col("below_loq_sum"), n).alias("below_loq_pct"))


def value_counts(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    """Rows per value, most frequent first; null is dropped unless asked for."""
    if not keep_null:
        df = df.dropna(subset=[column])
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))


def group_size(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def recap_stats(df: DataFrame, keys: Sequence[str], value: str = "value", flag: str = "below_loq") -> DataFrame:
    """Min, max, mean, sd and size of the quantified values per group, largest group first."""
    return (df.where(~col(flag)).groupBy(*keys)
            .agg(F.min(col(value)).alias("min"), F.max(col(value)).alias("max"),
                 F.avg(col(value)).alias("mean"), F.stddev_samp(col(value)).alias("sd"),
                 F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), *keys))


def recap_sampling(agg: DataFrame, keys: Sequence[str], site: str = "site_id", samples: str = "n") -> DataFrame:
    """Distinct sites, and sum, median, min and max of the per-site sample counts."""
    agg = staged(keys_not_null(agg, keys).select(*keys, site, samples))
    totals = agg.groupBy(*keys).agg(
        F.count_distinct(col(site)).alias("n_sites"), F.sum(samples).alias("n_measurements"),
        F.min(samples).alias("min_measurements"), F.max(samples).alias("max_measurements"))
    medians = quantiles(agg, keys, samples, {"med_measurements": 0.5})
    return totals.join(medians, list(keys), "left")


def recap_country_year(agg: DataFrame) -> DataFrame:
    """Per country, year and target: mean and sd of site means, total samples, total below LOQ."""
    return agg.groupBy("country", "year", "target").agg(
        F.avg("mean").alias("mean_of_means"), F.stddev_samp("mean").alias("sd_of_means"),
        F.sum("n").alias("n_samples"), F.sum("below_loq_sum").alias("n_below_loq"))


def site_target_profile(meas: DataFrame, keys: Sequence[str] = ("site_id", "target"),
                        value: str = "value") -> DataFrame:
    """Median, mean, sd, min, max, distinct values and rows of the non-null values."""
    rows = staged(keys_not_null(meas, keys).where(col(value).isNotNull()).select(*keys, value))
    moments = rows.groupBy(*keys).agg(
        F.avg(col(value)).alias("mean"), F.stddev_samp(col(value)).alias("sd"),
        F.min(col(value)).alias("min"), F.max(col(value)).alias("max"), F.count(F.lit(1)).alias("n"), F.count_distinct(col(value)).alias("n_distinct"))
    middle = order_statistics(rows, keys, value, {"__a": lambda n: F.floor((n - 1) / 2), "__b": lambda n: F.ceil((n - 1) / 2)})
    medians = middle.select(*keys, ((F.col("__a") + F.col("__b")) / 2).alias("median"))
    return moments.join(medians, list(keys)).select(*keys, "mean", "sd", "min", "max", "n", "median", "n_distinct")


def count_distinct_by(df: DataFrame, key: str, column: str, approximate: bool = False) -> DataFrame:
    """Distinct values per key, most first."""
    distinct = F.approx_count_distinct(col(column)) if approximate else F.count_distinct(col(column))
    return (keys_not_null(df, [key]).groupBy(key).agg(distinct.alias("n_distinct"))
            .orderBy(F.desc("n_distinct"), key))


def count_distinct_with_null(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.groupBy(key).agg(distinct_with_null(col(column)).alias("n_distinct"))


def collect_values(df: DataFrame, key: str, column: str) -> DataFrame:
    """Sorted distinct values per key, for columns with a small vocabulary."""
    return (df.select(key, column).distinct().groupBy(key)
            .agg(F.sort_array(F.collect_list(col(column))).alias("values")))


def multi_unit_targets(meas: DataFrame, key: str = "target", unit: str = "uom") -> DataFrame:
    """Targets measured in more than one unit, with the units; units are counted first, and collected for those targets only."""
    pairs = staged(meas.select(key, unit).distinct())
    several = pairs.groupBy(col(key).alias("__key")).agg(F.count(col(unit)).cast("int").alias("n_units")).where("n_units > 1")
    return (pairs.join(several, col(key).eqNullSafe(F.col("__key"))).groupBy(key, "n_units")
            .agg(F.sort_array(F.collect_list(col(unit))).alias("units")).select(key, "units", "n_units"))


def dataset_summary(df: DataFrame, distinct: Sequence[str], date_column: str) -> DataFrame:
    """One row: distinct values of the given columns, first and last date."""
    return df.agg(*[F.count_distinct(col(c)).alias(f"n_{c}") for c in distinct],
                  F.min(col(date_column)).alias("first_date"), F.max(col(date_column)).alias("last_date"))


def missing_rate(df: DataFrame, value: str = "value", flag: str = "below_loq") -> DataFrame:
    """Count and percentage of null values and of values below LOQ over all rows."""
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("n_rows"), (rows - F.count(col(value))).alias("n_missing"),
        F.sum(col(flag).cast("long")).alias("n_below_loq"),
        percent(rows - F.count(col(value)), rows).alias("missing_pct"),
        percent(F.sum(col(flag).cast("long")), rows).alias("below_loq_pct"))


def data_completeness(meas: DataFrame, target: str = "target", season: str = "season") -> DataFrame:
    """Per target and season: totals, missing and below-LOQ rows, sites, years, shares; in report order.

    The sites of all rows come out of the same scan, as a grouping set of its own.
    """
    rows = F.count(F.lit(1))
    both = staged(meas.groupingSets([[col(target), col(season)], []], col(target), col(season)).agg(
        F.grouping_id().alias("__set"), rows.alias("total_values"), (rows - F.count("value")).alias("missing_values"),
        F.sum(col("below_loq").cast("long")).alias("not_measured_values"),
        distinct_with_null(col("site_id")).alias("number_of_sites"),
        distinct_with_null(col("year")).alias("number_of_years")))
    total_sites = one_row(both.where("__set = 3").select("number_of_sites")).getField("number_of_sites")
    return (both.where("__set = 0").drop("__set")
            .withColumn("missing_perc", percent(F.col("missing_values"), F.col("total_values")))
            .withColumn("not_measured_perc", percent(F.col("not_measured_values"), F.col("total_values")))
            .withColumn("avg_meas_per_site", ratio(F.col("total_values"), F.col("number_of_sites")))
            .withColumn("meas_site_ratio", percent(F.col("number_of_sites"), total_sites))
            .orderBy(F.desc("total_values"), "number_of_sites", F.desc("avg_meas_per_site"),
                     "not_measured_perc", "missing_perc", target, season))


def mean_na_propagating(df: DataFrame, keys: Sequence[str], value: str = "value", fill: float | None = 0.0) -> DataFrame:
    """Mean and sd that are missing if any input is missing, then filled with a constant."""
    out = df.groupBy(*keys).agg(mean_if_complete(col(value)).alias("avg"), stddev_if_complete(col(value)).alias("sd"))
    return out if fill is None else out.fillna(fill, ["avg", "sd"])


def common_to_all_groups(df: DataFrame, group_keys: Sequence[str], value: str) -> DataFrame:
    """Values that occur in every group (relational division)."""
    pairs = staged(df.select(*group_keys, value).distinct())
    groups = one_row(pairs.select(*group_keys).distinct().agg(F.count(F.lit(1)).alias("n"))).getField("n")
    per_value = pairs.dropna(subset=[value]).groupBy(value).agg(F.count(F.lit(1)).alias("n_groups"))
    return per_value.where(F.col("n_groups") == groups)


def column_means(df: DataFrame, columns: Sequence[str], median: bool = False) -> DataFrame:
    """Mean, or median, of many columns in one pass; one row."""
    if not median:
        return df.agg(*[F.avg(col(c)).alias(c) for c in columns])
    long = staged(unpivot_columns(df.select(*[col(c).cast("double").alias(c) for c in columns]), [], columns, "column", "value"))
    medians = quantiles(long, ["column"], "value", {"median": 0.5})
    return medians.agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns])


def tukey_five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, lower hinge, median, upper hinge and maximum per group."""
    depth = lambda n: F.floor((n + 3) / 2) / 2
    # One-based places; a half place is the mean of the two values around it.
    middles = {"lower_hinge": depth, "median": lambda n: (n + 1) / 2, "upper_hinge": lambda n: n + 1 - depth(n)}
    places = {f"__{edge}_{name}": (lambda n, at=at, f=f: f(at(n)) - 1) for name, at in middles.items() for edge, f in (("low", F.floor), ("high", F.ceil))}
    rows = staged(df.where(col(value).isNotNull()).select(*keys, value))
    found = order_statistics(rows, keys, value, {"min": lambda n: F.lit(0), "max": lambda n: n - 1, **places})
    mean = lambda name: ((F.col(f"__low_{name}") + F.col(f"__high_{name}")) / 2).alias(name)
    return found.select(*keys, "min", mean("lower_hinge"), mean("median"), mean("upper_hinge"), "max", F.col("n_group").alias("n"))


def grouped_mutate(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Attach group mean, sd and size to every row.

    Aggregated first and joined back: no group is sorted in one task, as a window would do. Rows stay
    where they are if the statistics are small; else the join splits a hot group.
    """
    stats = staged(df.groupBy(*keys).agg(F.avg(col(value)).alias("group_mean"), F.stddev_samp(col(value)).alias("group_sd"),
                                         F.count(col(value)).alias("group_n")))
    return join_null_safe(df, stats, keys, "inner")


def busiest_site_series(meas: DataFrame, target: str, columns: Sequence[str] = ("sampled_on", "value")) -> DataFrame:
    """Dated values of the site with most rows for a target, in date order."""
    rows = meas.where(col("target") == target)
    busiest = (rows.dropna(subset=["site_id"]).groupBy("site_id").agg(F.count(F.lit(1)).alias("__n"))
               .orderBy(F.desc("__n"), "site_id").limit(1).select("site_id"))
    return rows.join(busiest, "site_id", "left_semi").select("site_id", *columns).orderBy(*columns)


def sort_mixed(df: DataFrame, descending: Sequence[str], ascending: Sequence[str]) -> DataFrame:
    """Several keys, mixed direction, nulls last."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in descending], *[F.asc_nulls_last(c) for c in ascending])


def top_k(df: DataFrame, k: int, key: str = "target", distinct: str | None = None) -> DataFrame:
    """The k keys with most rows, or most distinct values of a column; ties by name."""
    weight = F.count(F.lit(1)) if distinct is None else F.count_distinct(col(distinct))
    return (keys_not_null(df, [key]).groupBy(key).agg(weight.alias("weight"))
            .orderBy(F.desc("weight"), key).limit(k))


def top_k_targets(df: DataFrame, k: int, key: str = "target", distinct: str | None = None) -> DataFrame:
    """All rows of the k most measured targets."""
    return df.join(top_k(df, k, key, distinct).select(key), key, "left_semi")


def frequent_targets(df: DataFrame, threshold: int, key: str = "target", flag: str = "below_loq") -> DataFrame:
    """All quantified rows of the targets with more than ``threshold`` of them."""
    quantified = df.where(~col(flag))
    often = quantified.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > threshold)
    return quantified.join(staged(often.select(key)), key, "left_semi")


def counts_by_year(df: DataFrame, year: str = "year", by_count: bool = False) -> DataFrame:
    """Rows per year, in order of year or of count."""
    out = df.dropna(subset=[year]).groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), year) if by_count else out.orderBy(year)


def crosstab(df: DataFrame, a: str, b: str, b_values: Sequence[str]) -> DataFrame:
    """Two-way table of counts, 0 where a combination does not occur."""
    return fill_null(df.groupBy(a).pivot(b, list(b_values)).agg(F.count(F.lit(1))), [str(x) for x in b_values], 0)


def trend_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group."""
    return (df.where(col(x).isNotNull() & col(y).isNotNull()).groupBy(*keys)
            .agg(F.regr_slope(col(y), col(x)).alias("slope"), F.regr_intercept(col(y), col(x)).alias("intercept"),
                 F.count(F.lit(1)).alias("n")))
