"""Order statistics of the means of all pairs of a group's values, without building the pairs.

A group of n values has n(n+1)/2 pair means, each value with itself included. How many are at most t is a merge count over two copies of the
values: for every x the values up to 2t - x. The values are cut into sorted slices. The ends and sizes of two slices decide for most
pairs of slices whether all or none of their pair means count, so that only a staircase of pairs of slices is looked into, in tasks of their own.
The ends of the slices alone bring the interval of a place down to a few of its pairs; then each round counts at several thresholds between
its ends, and keeps the part that holds the place, until the distinct pairs left are few enough to be listed by a join on narrow buckets.
Memory and shuffles stay linear in the values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.nulls import col, keys_not_null
from limnos.functions.ranks import SAMPLE_EVERY, positions
from limnos.session import shuffle_width, staged

#: Parts an interval is cut into in a round, and distinct pairs of an interval that are listed.
PARTS = 16
LISTED = 50_000
#: Distinct values of a slice, at most.
SLICE_VALUES = 4096
#: Thresholds lie beside round fractions, where sums of round values would meet them.
_OFFSET = 0.381966


def pair_mean_statistics(df: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, parts: int = PARTS, listed: int = LISTED,
                         sample_every: int = SAMPLE_EVERY) -> DataFrame:
    """``keys, name, pair_mean``: the pair mean at the place (from 1) that ``wanted`` (keys, name, place) gives.

    Rows without a key or a value do not count; places outside a group's pairs give no row. Exact up to the rounding of a sum of two values.
    """
    names = [col(k) for k in keys]
    counted = staged(keys_not_null(df, keys).where(col(value).isNotNull()).groupBy(*names, col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("n_equal")))
    slices = _slices(counted, keys, sample_every)
    ends = slices.groupBy(*names).agg(F.min("__least").alias("__least"), F.max("__most").alias("__most"), F.sum("__n").alias("__size"), F.sum("__kinds").alias("__kinds"))
    pairs = F.col("__size") * (F.col("__size") + 1) / 2
    spread = F.greatest(F.col("__most") - F.col("__least"), F.abs("__least") * 1e-9, F.lit(1e-300))
    # Pair means of an interval lie above ``low`` and up to ``high``; ``before`` counts those up to ``low``, ``d_low`` and ``d_high`` the distinct pairs up to its ends.
    open_ = staged(wanted.join(ends, list(keys)).where((F.col("place") >= 1) & (F.col("place") <= pairs))
                   .select(*names, "name", "place", (F.col("__least") - spread).alias("low"), F.col("__most").alias("high"), F.lit(0).cast("long").alias("before"),
                           F.lit(0).cast("long").alias("d_low"), F.shiftright(F.col("__kinds") * (F.col("__kinds") + 1), 1).alias("d_high")))
    middle = F.col("low") + (F.col("high") - F.col("low")) * 0.5
    closed = (middle <= F.col("low")) | (middle >= F.col("high"))  # one number is left
    few = ~closed & (F.col("d_high") - F.col("d_low") <= listed)
    found, first = [], True
    while True:
        found.append(open_.where(closed).select(*names, "name", F.col("high").alias("pair_mean")))
        found.append(_listed(counted, open_.where(few), keys))
        rest = open_.where(~closed & ~few)
        if rest.isEmpty():
            break
        open_ = staged(_narrowed(slices, _bracketed(slices, rest, keys) if first else rest, keys, parts))
        first = False
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _slices(counted: DataFrame, keys: Sequence[str], sample_every: int) -> DataFrame:
    """Runs of a group's distinct values: ends, values ``__n`` and distinct values ``__kinds``, and the sorted values with their copies."""
    names = [col(k) for k in keys]
    size = min(SLICE_VALUES, sample_every)
    placed = positions(counted, keys, ["__x"], "__place", sample_every)
    return staged(placed.groupBy(*names, F.floor((F.col("__place") - 1) / size).alias("__slice")).agg(
        F.min("__x").alias("__least"), F.max("__x").alias("__most"), F.sum("n_equal").alias("__n"), F.count(F.lit(1)).alias("__kinds"),
        F.sort_array(F.collect_list(F.struct("__x", "n_equal"))).alias("__values")))


def _outlines(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ends and sizes of each group's slices in order, as arrays of one entry for a slice."""
    entry = F.struct("__slice", "__least", "__most", "__n", "__kinds")
    whole = slices.groupBy(*[col(k) for k in keys]).agg(F.sort_array(F.collect_list(entry)).alias("__all"))
    return whole.select(*[col(k) for k in keys], *[F.col(f"__all.{c}").alias(f"__all{c}") for c in ("__slice", "__least", "__most", "__n", "__kinds")])


def _bracket(least: np.ndarray, most: np.ndarray, n: np.ndarray, place: int, low: float, high: float) -> tuple[float, float]:
    """The interval of a place as far as the ends of the slices prove it: surely fewer pair means up to the new ``low``, enough up to ``high``."""
    upto = np.concatenate(([0], n.cumsum()))

    def count(edge: np.ndarray, t: float) -> int:
        mirrored = 2 * t - edge
        return (int((n * upto[np.searchsorted(edge, mirrored, side="right")]).sum()) + int(n[edge <= mirrored].sum())) >> 1

    def last(edge: np.ndarray, a: float, b: float) -> tuple[float, float]:
        while a < (t := a + (b - a) * 0.5) < b:
            a, b = (t, b) if count(edge, t) < place else (a, t)
        return a, b

    # Counting slices by their least values gives too many pairs, by their greatest too few.
    return last(least, low, high)[0] if count(least, low) < place else low, last(most, low, high)[1]


def _bracketed(slices: DataFrame, rest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals as narrow as the ends of the slices make them."""
    @F.pandas_udf("low double, high double")
    def bracket(least: pd.Series, most: pd.Series, n: pd.Series, place: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        found = [_bracket(np.asarray(a, float), np.asarray(b, float), np.asarray(c, np.int64), *r) for a, b, c, *r in zip(least, most, n, place, low, high)]
        return pd.DataFrame(found, columns=["low", "high"])

    joined = rest.join(_outlines(slices, keys), list(keys)).withColumn("__b", bracket("__all__least", "__all__most", "__all__n", "place", "low", "high"))
    return staged(joined.withColumns({"low": F.col("__b.low"), "high": F.col("__b.high")}).select(*rest.columns))


def _undecided(least: np.ndarray, most: np.ndarray, n: np.ndarray, kinds: np.ndarray, t: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Ordered pairs and distinct ordered pairs up to t in the pairs of slices that their ends decide, and for each slice the run of the others.

    A value that pairs with itself counts once more, so that ordered pairs, halved, are each pair once; ``_look`` adds those of the slice around t.
    """
    whole = np.searchsorted(most, 2 * t - most, side="right")
    part = np.maximum(np.searchsorted(least, 2 * t - least, side="right"), whole)
    upto, distinct = (np.concatenate(([0], x.cumsum())) for x in (n, kinds))
    below = most <= 2 * t - most
    return int((n * upto[whole]).sum() + n[below].sum()), int((kinds * distinct[whole]).sum() + kinds[below].sum()), whole, part


def _narrowed(slices: DataFrame, rest: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """The part of each interval that holds its place."""
    names = [col(k) for k in keys]
    share = lambda i: (i + F.lit(_OFFSET)) / float(parts)
    inner = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * share(i))
    asked = rest.select(*names, F.explode(F.concat(inner, F.array("low", "high"))).alias("__t")).distinct()

    @F.pandas_udf("c long, d long, pairs array<struct<a:long,b:long>>")
    def decide(number: pd.Series, least: pd.Series, most: pd.Series, n: pd.Series, kinds: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = []
        for numbers, a, b, c, d, at in zip(number, least, most, n, kinds, t):
            ordered, distinct, whole, part = _undecided(np.asarray(a, float), np.asarray(b, float), np.asarray(c, np.int64), np.asarray(d, np.int64), at)
            out.append((ordered, distinct, [{"a": int(numbers[i]), "b": int(numbers[j])} for i in np.flatnonzero(part > whole) for j in range(whole[i], part[i])]))
        return pd.DataFrame(out, columns=["c", "d", "pairs"])

    outlines = asked.join(_outlines(slices, keys), list(keys)).repartition(shuffle_width(rest.sparkSession), *names, "__t")
    decided = staged(outlines.select(*names, "__t", decide(*[f"__all{c}" for c in ("__slice", "__least", "__most", "__n", "__kinds")], "__t").alias("__d"))
                     .select(*names, "__t", "__d.c", "__d.d", "__d.pairs"))
    pairs = decided.select(*names, "__t", F.explode("pairs").alias("__p")).groupBy(*names, "__p.a", "__p.b").agg(F.sort_array(F.collect_list("__t")).alias("__ts"))
    values = lambda which: slices.select(*names, F.col("__slice").alias(which), F.col("__values.__x").alias(f"__x{which}"), F.col("__values.n_equal").alias(f"__n{which}"))
    looked = staged(pairs).join(values("a"), [*keys, "a"]).join(values("b"), [*keys, "b"]).select(*names, "a", "b", "__ts", "__xa", "__na", "__xb", "__nb")
    counted = looked.mapInArrow(_look(len(names)), _look_schema(slices, keys))
    ordered = decided.select(*names, "__t", "c", "d").unionByName(counted)
    counts = staged(ordered.groupBy(*names, "__t").agg(F.shiftright(F.sum("c"), 1).alias("__c"), F.shiftright(F.sum("d"), 1).alias("__d")))
    tried = rest.join(counts, list(keys)).where((F.col("__t") >= F.col("low")) & (F.col("__t") <= F.col("high")))
    under, entry = F.col("__c") < F.col("place"), F.struct("__t", "__c", "__d")
    found = tried.groupBy(*names, "name").agg(F.max(F.when(under, entry)).alias("__a"), F.min(F.when(~under, entry)).alias("__b"))
    return rest.join(found, [*keys, "name"]).select(
        *names, "name", "place", F.coalesce("__a.__t", "low").alias("low"), F.coalesce("__b.__t", "high").alias("high"), F.coalesce("__a.__c", "before").alias("before"),
        F.coalesce("__a.__d", "d_low").alias("d_low"), F.coalesce("__b.__d", "d_high").alias("d_high"))


def _look_schema(slices: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([*[f"`{k}` {slices.schema[k].dataType.simpleString()}" for k in keys], "__t double", "c long", "d long"])


def _look(n_keys: int):
    """Ordered pairs up to each threshold with the first value in one slice and the second in another; in one slice a value with itself counts once more."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, c, d = [], [], [], []
            for i in range(batch.num_rows):
                ts, xa, na, xb, nb = (batch.column(n_keys + 2 + j)[i].values.to_numpy(zero_copy_only=False) for j in range(5))
                upto = np.concatenate(([0], nb.cumsum()))
                same = batch.column(n_keys)[i] == batch.column(n_keys + 1)[i]
                for t in ts:
                    mirrored = 2 * t - xa
                    below = np.searchsorted(xb, mirrored, side="right")
                    alone = (xa <= mirrored) & same
                    rows.append(i), at.append(t), c.append(int((na * upto[below]).sum() + na[alone].sum())), d.append(int(below.sum() + alone.sum()))
            # The keys alone are repeated for each threshold, not the values of the slices.
            repeated = [batch.column(j).take(pa.array(rows, pa.int64())) for j in range(n_keys)]
            yield pa.RecordBatch.from_arrays([*repeated, pa.array(at, pa.float64()), pa.array(c, pa.int64()), pa.array(d, pa.int64())],
                                             names=[*batch.schema.names[:n_keys], "__t", "c", "d"])
    return look


def _listed(counted: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pair mean at the place of each interval, from its pairs: values whose mirror images lie in the same narrow bucket."""
    names = [col(k) for k in keys]
    width = 2 * (F.col("high") - F.col("low"))
    bucket = lambda x: F.floor(x / F.col("__w"))
    ranges = few.withColumn("__w", width)
    values = counted.join(ranges.select(*names, "name", "__w"), list(keys)).select(*names, "name", F.col("__x").alias("__y"), F.col("n_equal").alias("__m"), bucket(F.col("__x")).alias("__bucket"))
    ends = (2 * F.col("low") - F.col("__x"), 2 * F.col("high") - F.col("__x"))
    mirrored = (counted.join(ranges, list(keys))
                .select(*names, "name", "place", "before", "__x", "n_equal", ends[0].alias("__from"), ends[1].alias("__to"), F.explode(F.sequence(bucket(ends[0]), bucket(ends[1]))).alias("__bucket")))
    pairs = (mirrored.join(values, [*keys, "name", "__bucket"])
             .where((F.col("__y") >= F.col("__x")) & (F.col("__y") > F.col("__from")) & (F.col("__y") <= F.col("__to"))))
    weight = F.when(F.col("__x") == F.col("__y"), F.shiftright(F.col("n_equal") * (F.col("n_equal") + 1), 1)).otherwise(F.col("n_equal") * F.col("__m"))
    means = pairs.groupBy(*names, "name", "place", "before", ((F.col("__x") + F.col("__y")) / 2).alias("mean")).agg(F.sum(weight).alias("n"))
    # As many entries as distinct pairs are listed, at most.
    whole = means.groupBy(*names, "name", "place", "before").agg(F.sort_array(F.collect_list(F.struct("mean", "n"))).alias("__means"))
    start = F.struct(F.col("before").alias("upto"), F.lit(0).alias("i"))

    def step(s: Column, b: Column) -> Column:
        upto = s["upto"] + b["n"]
        return F.struct(upto.alias("upto"), (s["i"] + (upto < F.col("place")).cast("int")).alias("i"))

    walk = F.aggregate("__means", start, step)
    at = F.least(walk["i"], F.size("__means") - 1)  # a count off by the rounding of a sum stays inside
    return whole.select(*names, "name", F.get("__means", at)["mean"].alias("pair_mean"))
