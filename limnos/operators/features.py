"""Feature preparation: scaling, imputation, variance filter, sampling and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from limnos.functions.draws import draw, shuffled_position
from limnos.functions.nulls import (col, drop_null_rows, fill_null, mean_if_complete,
                                    one_row, ratio, stddev_if_complete, unpivot_columns)
from limnos.operators.columns import composite_key
from limnos.operators.reshape import pivot_fill_absent, pivot_values
from limnos.session import staged


def _column_stats(df: DataFrame, columns: Sequence[str], *measures) -> list[Column]:
    """One-row statistics of many columns in one pass, as a scalar subquery per measure."""
    row = one_row(df.agg(*[m(col(c)).alias(f"{i}_{j}") for i, m in enumerate(measures)
                           for j, c in enumerate(columns)]))
    return [[row.getField(f"{i}_{j}") for j in range(len(columns))] for i in range(len(measures))]


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def scale_population(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with the n divisor; nulls are ignored and kept; a constant column becomes 0."""
    means, sds = _column_stats(df, columns, F.avg, F.stddev_pop)
    return _replace(df, {c: (col(c) - m) / F.when(s == 0, 1.0).otherwise(s) for c, m, s in zip(columns, means, sds)})


def scale_sample(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with the n-1 divisor; a constant column becomes null."""
    means, sds = _column_stats(df, columns, F.avg, F.stddev_samp)
    return _replace(df, {c: F.try_divide(col(c) - m, s) for c, m, s in zip(columns, means, sds)})


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sd (divisor n) of each column, to be applied to other rows; a constant or empty column has sd 1."""
    row = df.agg(*[f(col(c)).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def apply_scaling(df: DataFrame, scaling: Mapping[str, tuple[float, float]]) -> DataFrame:
    return _replace(df, {c: (col(c) - m) / s for c, (m, s) in scaling.items()})


def impute_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_null(df, columns, 0.0)


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A null feature becomes the mean of its column."""
    (means,) = _column_stats(df, columns, F.avg)
    return _replace(df, {c: F.coalesce(col(c), m) for c, m in zip(columns, means)})


def impute_global_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A null feature becomes the mean of all known cells of all columns."""
    total = sum((F.coalesce(F.sum(col(c)), F.lit(0.0)) for c in columns), F.lit(0.0))
    known = sum((F.count(col(c)) for c in columns), F.lit(0))
    mean = one_row(df.agg(ratio(total, known).alias("m"))).getField("m")
    return _replace(df, {c: F.coalesce(col(c), mean) for c in columns})


def variance_metrics(df: DataFrame, columns: Sequence[str], freq_cut: float = 80 / 20,
                     unique_cut: float = 33.0) -> DataFrame:
    """Per column: ratio of the two most common values, percentage of distinct values, and the verdict."""
    long = unpivot_columns(df.select(*[col(c).cast("double").alias(c) for c in columns]), [], columns, "column", "value")
    sizes = one_row(df.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    counts = (long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("n", F.when(col("value").isNotNull(), F.col("n"))))
    distinct = counts.groupBy("column").agg(F.count("n").alias("n_distinct"))
    # The limit on the row number is applied before the shuffle: two rows per column and task.
    common = Window.partitionBy("column").orderBy(F.desc_nulls_last("n"), "value")
    top = (counts.where("n IS NOT NULL").withColumn("__r", F.row_number().over(common)).where("__r <= 2")
           .groupBy("column").agg(F.max(F.when(F.col("__r") == 1, F.col("n"))).alias("__a"),
                                  F.max(F.when(F.col("__r") == 2, F.col("n"))).alias("__b")))
    return (distinct.join(top, "column", "left")
            .withColumn("freq_ratio", F.coalesce(ratio(F.col("__a"), F.col("__b")), F.lit(0.0)))
            .withColumn("percent_unique", ratio(F.col("n_distinct") * 100.0, sizes))
            .withColumn("zero_variance", F.col("n_distinct") <= 1)
            .withColumn("near_zero_variance", F.col("zero_variance") | ((F.col("freq_ratio") > float(freq_cut))
                                                                        & (F.col("percent_unique") <= float(unique_cut))))
            .drop("__a", "__b"))


def near_zero_variance(df: DataFrame, columns: Sequence[str], freq_cut: float = 80 / 20,
                       unique_cut: float = 33.0) -> DataFrame:
    """Drop the columns that hold (almost) one value."""
    verdict = variance_metrics(df, columns, freq_cut, unique_cut).where("near_zero_variance")
    dropped = {r["column"] for r in verdict.select("column").collect()}
    return df.select(*[col(c) for c in df.columns if c not in dropped])


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)


def drop_small_classes(df: DataFrame, label: str, at_least: int) -> DataFrame:
    kept = class_balance(df, label).where(F.col("n") >= at_least).select(label)
    return df.join(kept, label, "left_semi")


def oversample(df: DataFrame, label: str, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """All rows, plus draws with replacement until every label has the size of the largest.

    The draws of all labels are one range spread over the cluster; each picks a row by its shuffled number in the label, in one
    join. An empty table stays empty.
    """
    numbered = staged(shuffled_position(df.dropna(subset=[label]), [label], keys, seed, "__pos"))
    sizes = numbered.groupBy(label).agg(F.first("__pos_size").alias("__n")).orderBy(label).collect()  # one row per label
    largest = max((r["__n"] for r in sizes), default=0)
    rows = numbered.drop("__pos_size")
    kind, wanted = df.schema[label].dataType, F.lit(None)
    first = 0
    for r in sizes:
        upto = first + largest - r["__n"]
        mine = F.struct(F.lit(r[label]).cast(kind).alias("label"), F.lit(r["__n"]).cast("long").alias("n"), (F.col("id") - first).alias("i"))
        wanted = F.when((F.col("id") >= first) & (F.col("id") < upto), mine).otherwise(wanted)
        first = upto
    out = rows.drop("__pos").withColumn("copy", F.lit(0).cast("long"))
    if not first:
        return out
    drawn = df.sparkSession.range(first).select(wanted.alias("w")).select(
        F.col("w.label").alias(label), F.pmod(draw(seed + 1, F.col("w.label"), F.col("w.i")), F.col("w.n")).alias("__pos"), (F.col("w.i") + 1).alias("copy"))
    return out.unionByName(drawn.join(rows, [label, "__pos"]).drop("__pos"))


def undersample(df: DataFrame, label: str, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Shrink every label to the size of the smallest, without replacement."""
    labelled = df.dropna(subset=[label])
    smallest = one_row(labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))).getField("n")
    return (shuffled_position(labelled, [label], keys, seed, "__pos").where(F.col("__pos") < smallest)
            .select(*df.columns))


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], train: float = 0.5, seed: int = 0) -> DataFrame:
    """Add ``split`` = train/test with the label proportions kept to the row."""
    placed = shuffled_position(df.dropna(subset=[label]), [label], keys, seed, "__pos")
    cut = F.round(F.col("__pos_size") * F.lit(float(train)))
    return (placed.withColumn("split", F.when(F.col("__pos") < cut, "train").otherwise("test"))
            .select(*df.columns, "split"))


def targets_in_every_category(meas: DataFrame, category: str) -> DataFrame:
    """Targets with rows in every category."""
    pairs = meas.dropna(subset=[category, "target"]).select("target", category).distinct()
    total = one_row(pairs.select(category).distinct().agg(F.count(F.lit(1)).alias("n"))).getField("n")
    return (pairs.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == total).select("target"))


def targets_for_water_bodies(agg_wb: DataFrame, max_below_loq_pct: float = 20, min_samples: int = 5000, top: int = 6,
                             exclude: str = "compounds|Other") -> DataFrame:
    """Targets quantified and sampled often enough in every water-body type; the ``top`` most sampled."""
    kept = agg_wb.where(col("below_loq_pct") <= float(max_below_loq_pct))
    types = one_row(kept.agg(F.count_distinct("wb_code").alias("n"))).getField("n")
    return (kept.where(~col("target").rlike(exclude)).groupBy("target")
            .agg(F.count_distinct("wb_code").alias("__types"), F.min("n").alias("__least"), F.sum("n").alias("n"))
            .where((F.col("__types") == types) & (F.col("__least") >= min_samples))
            .orderBy(F.desc("n"), "target").limit(top).select("target", "n"))


# Grains of the feature tables: the observation key's parts.
GRAINS = {
    "site": ("wb_code", "site_id"),
    "semester": ("season", "wb_code", "site_id"),
    "month": ("month", "wb_code", "site_id"),
}


def feature_table(meas: DataFrame, grain: str = "site", stats: Sequence[str] = ("avg", "sd"),
                  targets: Sequence[str] | None = None, na_rm: bool = False, fill: float | None = 0.0) -> DataFrame:
    """Wide features per site, site and semester, or site and month: ``<stat>_<target>`` columns.

    A statistic with a missing input is missing (unless ``na_rm``) and then filled, like absent cells.
    """
    whole = F.count(F.lit(1)) == F.count("value")
    measures = {
        "avg": F.avg("value") if na_rm else mean_if_complete(col("value")),
        "sd": F.stddev_samp("value") if na_rm else stddev_if_complete(col("value")),
        "min": F.min("value") if na_rm else F.when(whole, F.min("value")),
        "max": F.max("value") if na_rm else F.when(whole, F.max("value")),
    }
    keyed = composite_key(meas, [col(c) for c in GRAINS[grain]], "obs_id")
    if targets is not None:
        keyed = keyed.where(col("target").isin(list(targets)))
    long = keyed.groupBy("obs_id", "target").agg(*[measures[s].alias(s) for s in stats])
    columns = list(targets) if targets is not None else pivot_values(meas)
    if fill is None:
        wide = long.groupBy("obs_id").pivot("target", columns).agg(*[F.max(s).alias(f"__{s}") for s in stats],
                                                                  F.count(F.lit(1)).alias("__n"))
        return wide.select("obs_id", *[col(f"{t}___{s}").alias(f"{s}_{t}") for s in stats for t in columns])
    return pivot_fill_absent(long.fillna(fill, list(stats)), ["obs_id"], list(stats), columns, fill=fill)


def feature_approaches(meas: DataFrame, grain: str = "site", stats: Sequence[str] = ("avg", "sd"),
                       targets: Sequence[str] | None = None, na_rm: bool = False, impute: str = "zero",
                       variance_filter: bool = True) -> DataFrame:
    """Feature table, near-constant columns dropped, scaled with the n-1 divisor.

    ``impute``: ``zero``, ``mean`` (column mean) or ``drop`` (complete rows only).
    """
    wide = feature_table(meas, grain, stats, targets, na_rm, 0.0 if impute == "zero" else None)
    wide = staged(wide)
    names = [c for c in wide.columns if c != "obs_id"]
    if impute == "mean":
        wide = impute_mean(wide, names)
    elif impute == "drop":
        wide = drop_null_rows(wide, names)
    if variance_filter:
        wide = near_zero_variance(wide, names)
    return scale_sample(wide, [c for c in wide.columns if c != "obs_id"])
