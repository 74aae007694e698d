"""Repeatable random draws.

Row order is not defined in Spark, so a seeded generator gives other rows on every retry. A draw
here is a digest of the seed and the row's own key: the same row gets the same draw on any cluster,
after any executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from limnos.functions.nulls import col
from limnos.session import shuffle_width

DRAW_BITS = 60


def draw(seed: int, *keys: Column) -> Column:
    """Integer draw, uniform over [0, 2**60)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    """Draw in the open interval (0, 1)."""
    return (draw(seed, *keys).cast("double") + 0.5) / float(2 ** DRAW_BITS)


def shuffled_position(df: DataFrame, groups: Sequence[str], keys: Sequence[str], seed: int,
                      out: str = "position") -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... in the order of their draws; adds ``<out>_size``.

    ``keys`` must identify a row. Draws are uniform, so their leading bits cut any group, however
    hot, into even slices: each slice is numbered by itself and shifted by the rows before it.
    """
    groups, slices = list(groups), 1
    while slices < shuffle_width(df.sparkSession):
        slices *= 2
    drawn = (df.withColumn("__draw", draw(seed, *[col(k) for k in keys]))
             .withColumn("__slice", F.shiftrightunsigned("__draw", DRAW_BITS - slices.bit_length() + 1)))
    in_group = Window.partitionBy(*groups)
    offsets = (drawn.groupBy(*groups, "__slice").agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__before", F.sum("__n").over(in_group.orderBy("__slice")) - F.col("__n"))
               .withColumn(f"{out}_size", F.sum("__n").over(in_group))
               .drop("__n"))
    in_slice = Window.partitionBy(*groups, "__slice").orderBy("__draw", *keys)
    return (drawn.withColumn("__row", F.row_number().over(in_slice) - 1)
            .join(offsets, [*groups, "__slice"])
            .withColumn(out, F.col("__before") + F.col("__row"))
            .drop("__draw", "__slice", "__before", "__row"))
