"""Exact ranks of groups of any size.

A plain ``row_number() over (partition by key order by value)`` sorts a whole group in one task, and
``percentile`` holds a group's values in one task's memory. Here all groups together are dealt by ranges of key and
value, sorted range by range and written; a range is ranked by itself and shifted by the rows its groups have in the ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from limnos.functions.nulls import col
from limnos.session import shuffle_width, staged

# Rows of a range, as long as there are no more than four times as many ranges as a shuffle has partitions.
SAMPLE_EVERY = 1 << 16

def _part() -> Column:
    return F.shiftright("__dealt_seq", 33)


def _dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sample_every: int) -> DataFrame:
    """Rows without a null key, written in the order of keys and ``order``; ``__dealt_seq`` holds the range and the place in it.

    ``rows`` is read three times, so it should be a written table.
    """
    known = rows.where(reduce(Column.__and__, [col(k).isNotNull() for k in keys]))
    ranges = max(1, min(-(-known.count() // sample_every), 4 * shuffle_width(rows.sparkSession)))
    by = [col(c) for c in (*keys, *order)]
    return staged(known.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("__dealt_seq", F.monotonically_increasing_id()))


def _shifts(dealt: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """For each group in each range ``__dealt_part``: its first ``__dealt_seq``, the weight before the range, and of the whole group."""
    runs = dealt.groupBy(*[col(k) for k in keys], _part().alias("__dealt_part")).agg(F.sum(weight).alias("__dealt_weight"), F.min("__dealt_seq").alias("__dealt_first"))
    group = Window.partitionBy(*[col(k) for k in keys])
    return staged(runs.withColumn("__dealt_before", F.sum("__dealt_weight").over(group.orderBy("__dealt_part")) - F.col("__dealt_weight")).withColumn("n_group", F.sum("__dealt_weight").over(group)).drop("__dealt_weight"))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str,
                  measures: Sequence[Column] = (), sample_every: int = SAMPLE_EVERY) -> DataFrame:
    """One row per group and distinct non-null value.

    Columns: keys, value, ``n_equal`` (copies), ``n_below`` (rows with a smaller value), ``n_group``,
    and any extra aggregate given in ``measures``.
    """
    counted = df.where(col(value).isNotNull()).groupBy(*[col(k) for k in keys], col(value)).agg(F.count(F.lit(1)).alias("n_equal"), *measures)
    counted = staged(counted if keys else counted.withColumn("__all_rows", F.lit(0)))
    by = list(keys) or ["__all_rows"]
    dealt = _dealt(counted, by, [value], sample_every)
    running = Window.partitionBy(*[col(k) for k in by], "__dealt_part").orderBy("__dealt_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (dealt.withColumn("__dealt_part", _part()).withColumn("__dealt_running", F.sum("n_equal").over(running)).join(_shifts(dealt, by, F.col("n_equal")), [*by, "__dealt_part"])
            .withColumn("n_below", F.col("__dealt_before") + F.col("__dealt_running") - F.col("n_equal")).drop("__dealt_seq", "__dealt_part", "__dealt_first", "__dealt_before", "__dealt_running", "__all_rows"))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position",
              sample_every: int = SAMPLE_EVERY) -> DataFrame:
    """Number the rows of each group 1, 2, 3 ...; adds ``n_group``.

    ``order`` has to identify a row within its group; ``df`` should be a written table.
    """
    dealt = _dealt(df, keys, order, sample_every)
    # A group's rows are consecutive in a range.
    return (dealt.withColumn("__dealt_part", _part()).join(_shifts(dealt, keys, F.lit(1)), [*keys, "__dealt_part"])
            .withColumn(out, F.col("__dealt_before") + F.col("__dealt_seq") - F.col("__dealt_first") + 1).drop("__dealt_seq", "__dealt_part", "__dealt_first", "__dealt_before"))


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of every group, numbered from 1.

    Up to 1000 the optimizer limits the rows of a group before the shuffle. Beyond that a hot group is
    first thinned out in salted parts.
    """
    number = F.row_number()
    if k > 1000:
        salt = F.pmod(F.xxhash64(*[col(c) for c in order]), F.lit(shuffle_width(df.sparkSession)))
        part = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (df.withColumn("__salt", salt).withColumn(out, number.over(part)).where(F.col(out) <= k)
              .drop("__salt", out))
    return df.withColumn(out, number.over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)
