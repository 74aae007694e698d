"""Long to wide and back.

Data stay long as far as possible: targets are ranked and filtered first, then pivoted over an
explicit list, because a pivot without one costs an extra job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.nulls import col, drop_null_rows, unpivot_columns
from limnos.session import staged


def pivot_values(df: DataFrame, column: str = "target") -> list[str]:
    """Sorted pivot values. They become column names; of a large vocabulary, rank and pick targets before the pivot."""
    rows = df.select(col(column).alias("v")).where("v IS NOT NULL").distinct().orderBy("v").collect()
    return [r.v for r in rows]


def site_target_matrix(meas: DataFrame, targets: Sequence[str], keys: Sequence[str] = ("site_id", "wb_code", "rbd"),
                       value: str = "value", names: str = "target") -> DataFrame:
    """Mean value; a row per site, a column per target. Rows without any value are not produced."""
    rows = drop_null_rows(meas, [*keys, value]).where(col(names).isin(list(targets)))
    return rows.groupBy(*keys).pivot(names, list(targets)).agg(F.avg(col(value)))


def count_matrix(agg: DataFrame, targets: Sequence[str], keys: Sequence[str] = ("site_id",),
                 value: str = "n", names: str = "target") -> DataFrame:
    """Non-null count; NULL where the combination is absent, 0 where it holds nulls only."""
    return agg.groupBy(*keys).pivot(names, list(targets)).agg(F.count(col(value)))


def targets_per_category(meas: DataFrame, category: str, categories: Sequence[str],
                         names: str = "target") -> DataFrame:
    """Rows per target and category, wide, ordered by the category columns."""
    wide = meas.dropna(subset=[names]).groupBy(names).pivot(category, list(categories)).agg(F.count(F.lit(1)))
    return (wide.select(names, *[col(c) for c in categories])
            .orderBy(*[F.desc_nulls_last(f"`{c}`") for c in categories], names))


def _wide(df: DataFrame, ids: Sequence[str], names: str, targets: Sequence[str],
          cells: Mapping[str, Column]) -> DataFrame:
    """Pivot with columns named ``<value>_<target>``, value by value."""
    aliased = [c.alias(f"__{v}") for v, c in cells.items()]
    # A second aggregate keeps Spark's "<target>_<alias>" naming also for a single value column.
    wide = df.groupBy(*ids).pivot(names, list(targets)).agg(*aliased, F.count(F.lit(1)).alias("__always"))
    return wide.select(*ids, *[col(f"{t}___{v}").alias(f"{v}_{t}") for v in cells for t in targets])


def pivot_multi(df: DataFrame, ids: Sequence[str], values: Sequence[str], targets: Sequence[str],
                names: str = "target") -> DataFrame:
    """Several value columns per target, named ``<value>_<target>``; absent cells stay null.

    Expects one row per ids and target; of more, the greatest value is kept.
    """
    return _wide(df, ids, names, targets, {v: F.max(col(v)) for v in values})


def pivot_fill_absent(df: DataFrame, ids: Sequence[str], values: Sequence[str], targets: Sequence[str],
                      names: str = "target", fill: float = 0.0) -> DataFrame:
    """As ``pivot_multi``, but absent combinations become ``fill``; a null that was there stays null."""
    cells = {v: F.max(col(v)) for v in values}
    wide = df.groupBy(*ids).pivot(names, list(targets)).agg(
        *[c.alias(f"__{v}") for v, c in cells.items()], F.count(F.lit(1)).alias("__rows"))
    out = []
    for v in values:
        for t in targets:
            absent = col(f"{t}___rows").isNull()
            zero = F.lit(fill).cast(df.schema[v].dataType)
            out.append(F.when(absent, zero).otherwise(col(f"{t}___{v}")).alias(f"{v}_{t}"))
    return wide.select(*ids, *out)


def to_long(df: DataFrame, ids: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Wide statistics to (type, value) rows."""
    typed = df.select(*ids, *[col(s).cast("double").alias(s) for s in stats])
    return unpivot_columns(typed, ids, stats, "type", "value")


def unpivot_stats(df: DataFrame, ids: Sequence[str], stats: Sequence[str], targets: Sequence[str],
                  names: str = "target") -> DataFrame:
    """Statistics to long form, then wide again as ``<target>-<type>``."""
    named = to_long(df, [*ids, names], stats).withColumn("name", F.concat_ws("-", col(names), F.col("type")))
    return named.groupBy(*ids).pivot("name", [f"{t}-{s}" for t in targets for s in stats]).agg(F.max("value"))


def dense_columns(df: DataFrame, columns: Sequence[str], min_filled: int | None = None, no_nulls: bool = False,
                  min_cell: float | None = None) -> list[str]:
    """Names of the columns that are filled well enough; one pass over the data."""
    seen = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count(col(c)).alias(f"n_{i}") for i, c in enumerate(columns)],
                  *[F.min(col(c)).alias(f"min_{i}") for i, c in enumerate(columns)]).first()
    kept = []
    for i, c in enumerate(columns):
        filled, least = seen[f"n_{i}"], seen[f"min_{i}"]
        if min_filled is not None and filled < min_filled:
            continue
        if no_nulls and filled < seen["rows"]:
            continue
        if min_cell is not None and (least is None or least < min_cell):
            continue
        kept.append(c)
    return kept


def drop_sparse_columns(df: DataFrame, ids: Sequence[str], min_filled: int | None = None, no_nulls: bool = False,
                        min_cell: float | None = None, drop_empty_rows: bool = True) -> DataFrame:
    """Keep well-filled pivot columns, then drop the rows left empty; the pivot is computed once."""
    df = staged(df)
    kept = dense_columns(df, [c for c in df.columns if c not in ids], min_filled, no_nulls, min_cell)
    out = df.select(*ids, *[col(c) for c in kept])
    return drop_null_rows(out, kept, "all") if drop_empty_rows and kept else out


def order_columns_by_total(df: DataFrame, ids: Sequence[str], k: int | None = None) -> DataFrame:
    """Order the value columns by their total, greatest first, and keep the first k."""
    columns = [c for c in df.columns if c not in ids]
    totals = df.agg(*[F.sum(col(c)).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    ranked = sorted(zip(columns, totals), key=lambda pair: (-(pair[1] or 0), pair[0]))
    return df.select(*ids, *[col(c) for c, _ in ranked[:k]])
