"""Joins and duplicate handling.

No broadcast hints: a key list that comes out of an aggregate is written first, so the optimizer knows
its size and broadcasts it only if it is small. Beyond that adaptive execution splits a hot key of the
sort-merge join.
Duplicates are settled by aggregation, which combines before the shuffle, not by window sorts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.nulls import col, keys_not_null, one_row, percent, ratio
from limnos.session import staged


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a missing key equals a missing key."""
    renamed = right.select(*[col(c).alias(f"__{c}") if c in keys else col(c) for c in right.columns])
    same = [col(k).eqNullSafe(col(f"__{k}")) for k in keys]
    return left.join(renamed, reduce(and_, same), how).drop(*[f"__{k}" for k in keys])


def enrich_sites(meas: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    """Left join of measurements with one metadata row per site."""
    return meas.join(sites, key, "left")


def semi_known_sites(meas: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    return meas.join(sites.select(key).dropna(), key, "left_semi")


def anti_unmatched_sites(meas: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    """Sites of the measurements that metadata lacks, with their row counts."""
    counts = keys_not_null(meas, [key]).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(sites.select(key), key, "left_anti")


def drop_ambiguous_keys(df: DataFrame, keys: Sequence[str], repeats: Column | None = None) -> DataFrame:
    """Remove every row of a key that repeats.

    ``repeats`` is the aggregate that must not exceed 1; by default the row count.
    """
    repeats = F.count(F.lit(1)) if repeats is None else repeats
    unclear = staged(df.groupBy(*keys).agg(repeats.alias("__repeats")).where("__repeats > 1").drop("__repeats"))
    return join_null_safe(df, unclear, keys, "left_anti")


def semi_site_years(meas: DataFrame, pairs: DataFrame, target: str) -> DataFrame:
    """Rows of a target whose (site, year) pair qualified."""
    qualified = staged(pairs.select("site_id", "year").distinct())
    return meas.where(col("target") == target).join(qualified, ["site_id", "year"], "left_semi")


def semi_common_years(df: DataFrame, country: str) -> DataFrame:
    """Rows of the years in which the given country has data."""
    years = staged(df.where(col("country") == country).select("year").distinct())
    return df.join(years, "year", "left_semi")


def right_join_labels(labels: DataFrame, agg: DataFrame, key: str) -> DataFrame:
    """Attach labels to an aggregate and keep all of its rows."""
    return labels.join(agg, key, "right")


def full_outer_year_compare(agg: DataFrame, meas: DataFrame, samples: str = "n") -> DataFrame:
    """Samples per year in the aggregated source beside rows per year in the raw source."""
    left = agg.groupBy("year").agg(F.sum(samples).alias("n_aggregated"))
    right = meas.groupBy("year").agg(F.count(F.lit(1)).alias("n_raw"))
    return left.join(right, "year", "full")


def join_scalar_total(df: DataFrame, per_key: str, counted: str) -> DataFrame:
    """Distinct ``counted`` per key and their share, in percent, of the distinct total; both from one scan."""
    both = staged(df.groupingSets([[col(per_key)], []], col(per_key)).agg(F.grouping_id().alias("__set"), F.count_distinct(col(counted)).alias("n_distinct")))
    total = one_row(both.where("__set = 1").select("n_distinct")).getField("n_distinct")
    return both.where("__set = 0").select(per_key, "n_distinct", percent(F.col("n_distinct"), total).alias("share_pct"))


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  descending: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first in a stated order, nulls last.

    Ties are broken by the remaining columns, so the result does not depend on file order. Columns in
    ``descending`` must be numbers, dates or timestamps; text is ordered by ``priority_dedupe_sites``.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    rank: list[Column] = []
    for c in [*order, *rest]:
        value = col(c)
        if c in descending:
            kind = df.schema[c].dataType.typeName()
            if kind == "date":
                value = F.unix_date(value)
            elif kind.startswith("timestamp"):
                value = F.unix_micros(value.cast("timestamp"))
            value = -value
        rank += [col(c).isNull().alias(f"null_{c}"), value.alias(f"by_{c}")]
    row = F.struct(*[col(c) for c in df.columns if c not in keys])
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*rank)).alias("__first"))
    return first.select(*[col(c) if c in keys else F.col("__first").getField(c).alias(c) for c in df.columns])


def priority_dedupe_sites(sites: DataFrame, key: str = "site_id", scheme: str = "scheme") -> DataFrame:
    """Drop null ids; of a repeated id keep the row with the greatest scheme name."""
    others = [c for c in sites.columns if c not in (key, scheme)]
    row = F.struct(*[col(c) for c in sites.columns if c != key])
    rank = F.struct(col(scheme), *[col(c).alias(f"by_{c}") for c in others])
    best = sites.dropna(subset=[key]).groupBy(key).agg(F.max_by(row, rank).alias("__best"))
    return best.select(*[col(c) if c == key else F.col("__best").getField(c).alias(c) for c in sites.columns])


def duplicate_report(df: DataFrame, key: str, category: str) -> DataFrame:
    """Per category: rows overall, and rows and keys among the repeated keys."""
    per_key = staged(keys_not_null(df, [key]).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
                     .where("__n > 1").select(key))
    repeated = (df.join(per_key, key, "left_semi").groupBy(category)
                .agg(F.count(F.lit(1)).alias("rows_repeated"), F.count_distinct(col(key)).alias("keys_repeated")))
    overall = df.groupBy(category).agg(F.count(F.lit(1)).alias("rows_total"))
    return overall.join(repeated, category, "left").fillna(0, ["rows_repeated", "keys_repeated"])


def union_parts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def intersect_sets(*parts: DataFrame) -> DataFrame:
    """Values present in every part."""
    out = parts[0]
    for p in parts[1:]:
        out = out.intersect(p)
    return out


def except_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct values of the first part that the second lacks."""
    return a.subtract(b)


def integrity_check(meas: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    """One row: sites in use, how many are known, null keys on both sides, repeated metadata keys."""
    used = meas.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    known = sites.dropna(subset=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("n_meta"))
    checked = used.join(known, key, "left").agg(
        F.count(col(key)).alias("sites_used"),
        F.count("n_meta").alias("sites_matched"),
        F.coalesce(F.sum(F.when(col(key).isNull(), F.col("n_rows"))), F.lit(0)).alias("null_sites_in_data"))
    meta = one_row(sites.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(col(key).isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count(F.when(col(key).isNotNull() & (F.col("n") > 1), 1)).alias("repeated")))
    return (checked
            .withColumn("matched_pct", ratio(F.col("sites_matched") * 100.0, F.col("sites_used")))
            .withColumn("all_matched", F.col("sites_matched") == F.col("sites_used"))
            .withColumn("null_sites_in_metadata", meta.getField("nulls"))
            .withColumn("repeated_sites_in_metadata", meta.getField("repeated")))
