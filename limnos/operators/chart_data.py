"""The numbers behind the charts; drawing is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.draws import uniform
from limnos.functions.normal import normal_quantile
from limnos.functions.nulls import col, one_row
from limnos.functions.ranks import positions
from limnos.functions.selection import quantiles
from limnos.operators.joins import semi_site_years
from limnos.session import staged


def _as_number(df: DataFrame, column: str) -> Column:
    """Dates count as days since 1970."""
    return (F.unix_date(col(column)) if df.schema[column].dataType.typeName() == "date" else col(column)).cast("double")


def histogram_equal_width(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """``bins`` equal bins from the overall minimum to the maximum, the last one closed.

    Every bin of every group is listed, also the empty ones.
    """
    rows = df.withColumn("__v", _as_number(df, column)).where("__v IS NOT NULL")
    ends = one_row(rows.agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    lo, hi = ends.getField("lo"), ends.getField("hi")
    width = (hi - lo) / float(bins)
    bin_no = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("__v") - lo) / width), F.lit(bins - 1)))
    counts = rows.groupBy(*by, bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("__counts"))
    filled = totals.select(*by, "__counts", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return filled.select(
        *by, "bin", (lo + F.col("bin") * width).alias("bin_start"), (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce(F.try_element_at("__counts", F.col("bin")), F.lit(0).cast("long")).alias("n"))


def histogram_edges(df: DataFrame, column: str, first: float, last: float, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """Fixed equal edges, values outside dropped, the last bin closed; occupied bins only."""
    v, width = col(column).cast("double"), (last - first) / steps
    inside = df.where((v >= float(first)) & (v <= float(last)))
    bin_no = F.least(F.floor((v - float(first)) / float(width)), F.lit(steps - 1)).cast("int")
    return (inside.groupBy(*by, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_start", F.lit(float(first)) + F.col("bin") * float(width)))


def histogram_binwidth(df: DataFrame, column: str, width: float, by: Sequence[str] = (),
                       low: float | None = None, high: float | None = None) -> DataFrame:
    """Bins of a fixed width centred on its multiples, with optional limits."""
    v = col(column).cast("double")
    rows = df.where(v.isNotNull())
    if low is not None:
        rows = rows.where(v >= float(low))
    if high is not None:
        rows = rows.where(v <= float(high))
    centre = F.floor(v / float(width) + 0.5) * float(width)
    return rows.groupBy(*by, centre.cast("double").alias("bin_centre")).agg(F.count(F.lit(1)).alias("n"))


def boxplot_stats(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Quartiles, whiskers at the last point within 1.5 IQR of the box, and the number of outliers."""
    rows = staged(df.where(col(column).isNotNull()).select(*keys, column))
    box = staged(quantiles(rows, keys, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (col(column) >= F.col("q1") - reach) & (col(column) <= F.col("q3") + reach)
    return (rows.join(box, list(keys))
            .groupBy(*keys, "q1", "median", "q3")
            .agg(F.min(F.when(inside, col(column))).alias("whisker_low"),
                 F.max(F.when(inside, col(column))).alias("whisker_high"),
                 F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n")))


def density_curve(df: DataFrame, column: str, by: Sequence[str], grid: int = 128, bins: int = 512) -> DataFrame:
    """Gaussian kernel density per group on a shared grid over the overall range.

    Each value is shared between the two ends of its bin, by its distance from them, so the kernel sum of a group has
    ``bins`` + 1 terms whatever its size. With bins of width w and bandwidth h no density is farther from the sum over the values
    themselves than w ** 2 / (8 * sqrt(2 * pi) * h ** 3): the error of a straight line between two points of the kernel.
    Bandwidth: 0.9 * min(sd, IQR / 1.34) * n ** -0.2 of the exact values.
    """
    rows = staged(df.where(col(column).isNotNull()).select(*by, column, col(column).cast("double").alias("__v")))
    ends = one_row(rows.agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    lo, hi = ends.getField("lo"), ends.getField("hi")
    width = (hi - lo) / float(bins)
    place = F.coalesce((F.col("__v") - lo) / F.nullif(width, F.lit(0.0)), F.lit(0.0))
    placed = rows.withColumn("__p", place).withColumn("__bin", F.least(F.floor("__p"), F.lit(bins - 1)))
    # The share of a bin's values that goes to its upper end is a sum; the rest goes to the lower end.
    binned = placed.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("__c"), F.sum(F.col("__p") - F.col("__bin")).alias("__up"))
    curves = binned.groupBy(*by).agg(F.collect_list(F.struct("__bin", "__c", "__up")).alias("__bins"))
    iqr = quantiles(rows, by, column, {"__q1": 0.25, "__q3": 0.75}).select(*by, (F.col("__q3") - F.col("__q1")).alias("__iqr"))
    spread = rows.groupBy(*by).agg(F.stddev_samp("__v").alias("__sd"), F.min("__v").alias("__least"), F.count(F.lit(1)).alias("n"))
    nonzero = lambda c: F.nullif(c, F.lit(0.0))
    # Where half the values are equal the quartiles meet: then the sd, the size of the least value, or 1.
    scale = F.coalesce(nonzero(F.least("__sd", F.col("__iqr") / 1.34)), nonzero(F.col("__sd")), nonzero(F.abs("__least")), F.lit(1.0))
    ready = (curves.join(spread, list(by)).join(iqr, list(by))
             .withColumn("bandwidth", 0.9 * scale * F.pow(F.col("n"), F.lit(-0.2)))
             .withColumn("__lo", lo).withColumn("__range", hi - lo))
    points = ready.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn(
        "x", F.col("__lo") + F.col("point") * F.col("__range") / float(grid - 1))

    def kernel(total: Column, b: Column) -> Column:
        def at(end: Column) -> Column:
            z = (F.col("x") - F.col("__lo") - end * F.col("__range") / float(bins)) / F.col("bandwidth")
            return F.exp(-z * z / 2.0)

        low, up = b.getField("__bin"), b.getField("__up")
        return total + (b.getField("__c") - up) * at(low) + up * at(low + 1)

    return points.select(
        *by, "point", "x", "bandwidth",
        (F.aggregate("__bins", F.lit(0.0), kernel) / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi)))
        .alias("density"))


def qq_normal(df: DataFrame, column: str, by: Sequence[str], row_key: str) -> DataFrame:
    """Ordered values against normal quantiles at i/(n+1), with the line through the quartiles."""
    rows = staged(df.where(col(column).isNotNull()).select(*by, column, row_key))
    box = staged(quantiles(rows, by, column, {"__q1": 0.25, "__q3": 0.75}))
    slope = (F.col("__q3") - F.col("__q1")) / (normal_quantile(F.lit(0.75)) - normal_quantile(F.lit(0.25)))
    return (positions(rows, by, [column, row_key])
            .withColumn("theoretical", normal_quantile(F.col("position") / (F.col("n_group") + 1)))
            .join(box, list(by))
            .select(*by, "position", "theoretical", col(column).alias("sample"),
                    ((F.col("__q1") + F.col("__q3")) / 2 + slope * F.col("theoretical")).alias("line")))


def qq_two_sample(df: DataFrame, column: str, by: Sequence[str], row_key: str, seed: int = 0) -> DataFrame:
    """Observed sample against a simulated normal sample of the same size, mean and sd, rank by rank.

    Each row draws its own normal number from a digest of its key, so the simulation repeats exactly.
    """
    rows = staged(df.where(col(column).isNotNull()).select(*by, column, row_key))
    moments = rows.groupBy(*by).agg(F.avg(col(column)).alias("__mean"), F.stddev_samp(col(column)).alias("__sd"))
    # The draw is a column of its own, or every use of it in the quantile would digest the key again.
    drawn = staged(rows.withColumn("__u", uniform(seed, col(row_key))).select(*by, row_key, normal_quantile(F.col("__u")).alias("__z")))
    observed = positions(rows, by, [column, row_key]).select(*by, "position", col(column).alias("observed"))
    simulated = positions(drawn, by, ["__z", row_key]).select(*by, "position", "__z")
    return (observed.join(simulated, [*by, "position"]).join(moments, list(by))
            .select(*by, "position", "observed", (F.col("__mean") + F.col("__sd") * F.col("__z")).alias("simulated")))


def time_trace_panel(meas: DataFrame, pairs: DataFrame, target: str) -> DataFrame:
    """Dated value, depth and unit per site for one target, in plot order, with a label per panel.

    The global sort is range-partitioned over site and date, so a hot site spreads over many tasks.
    """
    rows = semi_site_years(meas, pairs, target)
    label = F.concat_ws(" ", F.lit(target), F.concat(F.lit("["), col("uom"), F.lit("]")), F.lit("at"),
                        col("site_id").cast("string"))
    return (rows.select("site_id", "sampled_on", "value", "depth", "uom", label.alias("panel"))
            .orderBy("site_id", "sampled_on", "value", "depth"))
