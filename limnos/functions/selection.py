"""Order statistics of groups of any size by counting, without sorting a group.

The values wanted of a group are named by their places in its order. A group starts as one cell, from its least to its greatest value.
A large cell is counted into equal bins, with the least and greatest value of each; only the bins that hold a wanted
place become cells of the next round, for all groups and places at once. A cell of one value is an answer, and a cell
of few rows is read as a whole. Every round is one partial aggregate over the rows of the cells left; nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.nulls import col, keys_not_null
from limnos.session import staged

#: Bins of a cell between its ends, and the most rows of a cell that are read as a whole.
BINS = 1024
CELL_ROWS = 4096

_ALL = "__all_rows"


def _bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0 and ``bins`` + 1 for the ends of a cell, 1 to ``bins`` between them."""
    v, a, b = (x.cast("double") * 0.5 for x in (value, low, high))  # halves, so that no difference overflows
    inner = F.floor(F.try_divide(v - a, b - a) * bins)
    return F.when(value == low, 0).when(value == high, bins + 1).otherwise(1 + F.greatest(F.lit(0), F.least(F.coalesce(inner, F.lit(0)), F.lit(bins - 1)))).cast("int")


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, places: Mapping[str, Callable[[Column], Column]],
                     bins: int = BINS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``n_group`` and one column per entry of ``places``: the value at a zero-based place, given as a function of the group's size.

    Null values do not count; groups with a null key or without a value are left out. Equal values take a place each. ``df`` is read twice and
    more, so it should be a written table.
    """
    keys = list(keys) or [_ALL]
    rows = (df.withColumn(_ALL, F.lit(0)) if keys == [_ALL] else df).where(col(value).isNotNull())
    rows = keys_not_null(rows, keys).select(*[col(k) for k in keys], col(value).alias("__v"))
    n = F.col("n_group")
    groups = staged(rows.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_group"), F.min("__v").alias("__low"), F.max("__v").alias("__high")))
    wanted = F.array_distinct(F.array(*[p(n).cast("long") for p in places.values()]))
    # A cell: its ends, its rows, the rows of its group before it, and the places wanted in it.
    cells = groups.select(*[col(k) for k in keys], "__low", "__high", n.alias("__n"), F.lit(0).cast("long").alias("__before"), wanted.alias("__places"))
    found: list[DataFrame] = []
    while True:
        single, small = F.col("__low") == F.col("__high"), F.col("__n") <= cell_rows
        found.append(cells.where(single).select(*[col(k) for k in keys], F.explode("__places").alias("__place"), F.col("__low").alias("__value")))
        found.append(_read_whole(rows, cells.where(~single & small), keys))
        large = cells.where(~single & ~small)
        if large.isEmpty():
            break
        cells = staged(_narrow(rows, large, keys, bins))
    at = reduce(DataFrame.unionByName, found)
    picked = at.groupBy(*[col(k) for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("__place", "__value"))).alias("__at"))
    joined = groups.join(picked, keys)
    out = joined.select(*[col(k) for k in keys], "n_group", *[F.try_element_at("__at", p(n).cast("long")).alias(name) for name, p in places.items()])
    return out.drop(_ALL)


def _in_cells(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the cell they lie in; cells of a group do not overlap, and there are as many as places at most."""
    renamed = cells.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__low", "__high", "__n", "__before", "__places")
    same = reduce(Column.__and__, [col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)])
    return rows.join(renamed, same & (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))


def _read_whole(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [col(k) for k in keys]
    read = _in_cells(rows, cells, keys).groupBy(*names, "__low").agg(
        F.sort_array(F.collect_list("__v")).alias("__values"), F.first("__before").alias("__before"), F.first("__places").alias("__places"))
    return (read.select(*names, "__values", "__before", F.explode("__places").alias("__place"))
            .select(*names, "__place", F.get("__values", (F.col("__place") - F.col("__before")).cast("int")).alias("__value")))


def _narrow(rows: DataFrame, cells: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """The bins of the cells that hold a wanted place, as cells."""
    names = [col(k) for k in keys]
    counted = (_in_cells(rows, cells, keys).withColumn("__bin", _bin_of(F.col("__v"), F.col("__low"), F.col("__high"), bins))
               .groupBy(*names, "__low", "__bin")
               .agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__from"), F.max("__v").alias("__to"), F.first("__before").alias("__before"), F.first("__places").alias("__places")))
    # At most ``bins`` + 2 entries of a cell.
    whole = counted.groupBy(*names, "__low").agg(
        F.sort_array(F.collect_list(F.struct("__bin", F.col("__n").alias("n"), F.col("__from").alias("a"), F.col("__to").alias("b")))).alias("__bins"),
        F.first("__before").alias("__before"), F.first("__places").alias("__places")).select(*names, "__bins", "__before", F.explode("__places").alias("__place"))
    # The rows before the bin that holds the place, and the number of that bin.
    start = F.struct(F.col("__before").alias("upto"), F.col("__before").alias("before"), F.lit(0).alias("i"))

    def step(s: Column, b: Column) -> Column:
        upto = s["upto"] + b["n"]
        passed = upto <= F.col("__place")
        return F.struct(upto.alias("upto"), F.when(passed, upto).otherwise(s["before"]).alias("before"), (s["i"] + passed.cast("int")).alias("i"))

    walk = F.aggregate("__bins", start, step)
    return (whole.withColumn("__w", walk).withColumn("__b", F.get("__bins", F.col("__w.i")))
            .groupBy(*names, F.col("__b.a").alias("__low"), F.col("__b.b").alias("__high"), F.col("__b.n").alias("__n"), F.col("__w.before").alias("__before"))
            .agg(F.collect_list("__place").alias("__places")))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], **sizes: int) -> DataFrame:
    """Exact quantiles per group, linearly interpolated: one column per entry of ``probabilities``."""
    place = lambda n, p: (n - 1).cast("double") * F.lit(float(p))
    ends = {f"__{edge}_{name}": (lambda n, p=p, f=f: f(place(n, p))) for name, p in probabilities.items() for edge, f in (("low", F.floor), ("high", F.ceil))}
    at = order_statistics(df, keys, value, ends, **sizes)
    low, high = (lambda name: F.col(f"__low_{name}")), (lambda name: F.col(f"__high_{name}"))
    share = lambda p: place(F.col("n_group"), p) - F.floor(place(F.col("n_group"), p))
    return at.select(*[col(k) for k in keys], *[(low(n) + share(p) * (high(n) - low(n))).alias(n) for n, p in probabilities.items()])
