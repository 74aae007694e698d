"""Exact null laws of the rank tests for small samples, as tables of cumulated probabilities.

The number of ways to reach each sum is found by dynamic programming over the ranks in whole numbers, once for each sample size
that occurs, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Samples of this size and more have no exact law here.
EXACT_BELOW = 50


def signed_rank_ways(n: int) -> list[int]:
    """Subsets of the ranks 1 to n with each sum."""
    ways = [1]
    for rank in range(1, n + 1):
        ways = [a + b for a, b in zip(ways + [0] * rank, [0] * rank + ways)]
    return ways


def rank_sum_ways(m: int, n: int) -> list[int]:
    """Orders of m and n values with each number of pairs in which the first is the larger."""
    ways = [1] + [0] * (m * n)
    for i in range(1, m + 1):  # times (1 - q ** (n + i)), divided by (1 - q ** i)
        ways = [w - (ways[s - n - i] if s >= n + i else 0) for s, w in enumerate(ways)]
        for s in range(i, len(ways)):
            ways[s] += ways[s - i]
    return ways


def _cumulated(ways: Sequence[int]) -> list[float]:
    total = sum(ways)
    return [w / total for w in accumulate(ways)]


def signed_rank_law(sizes: DataFrame) -> DataFrame:
    """``size, law``: the chance of each sum of positive ranks or a smaller one, for the sizes below ``EXACT_BELOW`` in a column ``size``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"size": b["size"], "law": [_cumulated(signed_rank_ways(int(n))) for n in b["size"]]})

    small = sizes.where((F.col("size") > 0) & (F.col("size") < EXACT_BELOW)).select(F.col("size").cast("long")).distinct()
    return small.mapInPandas(run, "size long, law array<double>")


def rank_sum_law(sizes: DataFrame) -> DataFrame:
    """``first, second, law``: the same for the rank-sum statistic of two samples, from columns ``first`` and ``second``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"first": b["first"], "second": b["second"], "law": [_cumulated(rank_sum_ways(int(m), int(n))) for m, n in zip(b["first"], b["second"])]})

    below = lambda c: (F.col(c) > 0) & (F.col(c) < EXACT_BELOW)
    small = sizes.where(below("first") & below("second")).select(F.col("first").cast("long"), F.col("second").cast("long")).distinct()
    return small.mapInPandas(run, "first long, second long, law array<double>")
