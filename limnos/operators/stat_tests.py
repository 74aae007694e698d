"""Normality and two-sample tests: moments or exact ranks per group, then a closed formula."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.normal import (normal_quantile, normal_upper_tail, polynomial, student_quantile,
                                     student_two_sided_p)
from limnos.functions.nulls import col, keys_not_null
from limnos.functions.pair_means import pair_mean_statistics
from limnos.functions.rank_laws import EXACT_BELOW, rank_sum_law, signed_rank_law
from limnos.functions.ranks import positions, ranked_values
from limnos.session import staged


def dagostino_k2(n: Column, skew: Column, kurt: Column) -> Column:
    """D'Agostino-Pearson K2 from population skewness and (non-excess) kurtosis; n >= 8."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    y = F.when(y == 0, 1.0).otherwise(y)
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (b2 - 1)) - 1.0
    ya = y / F.sqrt(2.0 / (w2 - 1))
    z1 = F.ln(ya + F.sqrt(ya * ya + 1)) / F.sqrt(0.5 * F.ln(w2))
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt - mean) / F.sqrt(var)
    s = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / s * (2.0 / s + F.sqrt(1.0 + 4.0 / (s * s)))
    d = 1.0 + x * F.sqrt(2.0 / (a - 4))
    third = F.signum(d) * F.cbrt((1.0 - 2.0 / a) / F.abs(F.nullif(d, F.lit(0.0))))
    z2 = (1.0 - 2.0 / (9.0 * a) - third) / F.sqrt(2.0 / (9.0 * a))
    return z1 * z1 + z2 * z2


def normality_dagostino(df: DataFrame, keys: Sequence[str], value: str = "value", alpha: float = 0.001) -> DataFrame:
    """K2, its p-value and the decision per group; groups under 8 values get NULL."""
    moments = (keys_not_null(df, keys).where(col(value).isNotNull()).groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("n"), F.skewness(col(value)).alias("skewness"),
                    (F.kurtosis(col(value)) + 3.0).alias("kurtosis")))
    n = F.when((F.col("n") >= 8) & F.col("skewness").isNotNull(), F.col("n").cast("double"))
    return (moments.withColumn("k2", dagostino_k2(n, F.col("skewness"), F.col("kurtosis")))
            .withColumn("p", F.exp(-F.col("k2") / 2.0))
            .withColumn("reject_normal", F.col("p") < float(alpha)))


def normality_shapiro(df: DataFrame, keys: Sequence[str], row_key: str, value: str = "value") -> DataFrame:
    """Shapiro-Wilk W and p per group, over all its rows; ``row_key`` identifies a row.

    The curve behind p was fitted to samples of up to 5,000 values; for larger groups p is extrapolated.
    """
    valued = staged(keys_not_null(df, keys).where(col(value).isNotNull()).select(*keys, value, row_key))
    scores = (positions(valued, keys, [value, row_key], "__i").withColumn("n", F.col("n_group").cast("double"))
              .withColumn("__m", normal_quantile((F.col("__i") - 0.375) / (F.col("n") + 0.25))))
    # Symmetric scores: the largest two carry their own weights, the rest are scaled.
    parts = scores.groupBy(*keys, "n").agg(
        F.sum(F.col("__m") * F.col("__m")).alias("mm"), F.max("__m").alias("m_last"),
        F.max(F.when(F.col("__i") == F.col("n") - 1, F.col("__m"))).alias("m_next"),
        F.sum(F.col("__m") * col(value)).alias("mx"),
        F.min(col(value)).alias("x_first"), F.max(col(value)).alias("x_last"),
        F.max(F.when(F.col("__i") == 2, col(value))).alias("x_second"),
        F.max(F.when(F.col("__i") == F.col("n") - 1, col(value))).alias("x_next"),
        (F.var_pop(col(value)) * F.col("n")).alias("ss"))
    n, mm, m1, m2 = F.col("n"), F.col("mm"), F.col("m_last"), F.col("m_next")
    root = 1.0 / F.sqrt(n)
    # Royston's (1995) weight corrections, constant term first.
    a1 = polynomial(root, (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)) + m1 / F.sqrt(mm)
    a2 = polynomial(root, (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)) + m2 / F.sqrt(mm)
    few = n <= 5
    phi = F.when(few, (mm - 2.0 * m1 * m1) / (1.0 - 2.0 * a1 * a1)).otherwise(
        (mm - 2.0 * m1 * m1 - 2.0 * m2 * m2) / (1.0 - 2.0 * a1 * a1 - 2.0 * a2 * a2))
    ends = F.col("x_last") - F.col("x_first")
    nexts = F.col("x_next") - F.col("x_second")
    inner = F.when(few, F.col("mx") - m1 * ends).otherwise(F.col("mx") - m1 * ends - m2 * nexts)
    linear = a1 * ends + F.when(few, 0.0).otherwise(a2 * nexts) + inner / F.sqrt(phi)
    w = F.when(F.col("ss") > 0, F.least(F.try_divide(linear * linear, F.col("ss")), F.lit(1.0)))
    logn, rest = F.ln(n), F.ln(1.0 - F.col("w"))
    # Royston's normalising polynomials for small and large samples.
    small = -F.ln(0.459 * n - 2.273 - rest)
    small_z = (small - polynomial(n, (0.5440, -0.39978, 0.025054, -0.0006714))) / F.exp(
        polynomial(n, (1.3822, -0.77857, 0.062767, -0.0020322)))
    large_z = (rest - polynomial(logn, (-1.5861, -0.31082, -0.083751, 0.0038915))) / F.exp(
        polynomial(logn, (-0.4803, -0.082676, 0.0030302)))
    return (parts.where("n >= 4").withColumn("w", w)
            .withColumn("p", normal_upper_tail(F.when(n <= 11, small_z).otherwise(large_z)))
            .select(*keys, n.cast("long").alias("n"), "w", "p"))


def season_means(df: DataFrame, keys: Sequence[str], pair: Sequence[str], value: str, side: str, first: str, second: str) -> DataFrame:
    """``__a`` and ``__b``: the means of both sides under each pair key of a group, null where a side has no value."""
    return staged(keys_not_null(df, keys).where(col(value).isNotNull() & col(side).isin(first, second)).groupBy(*keys, *pair)
                  .agg(F.avg(F.when(col(side) == first, col(value))).alias("__a"),
                       F.avg(F.when(col(side) == second, col(value))).alias("__b")))


def signed_rank_interval(df: DataFrame, keys: Sequence[str], pair: Sequence[str], value: str = "value", side: str = "season",
                         first: str = "summer", second: str = "winter", level: float = 0.95) -> DataFrame:
    """Location of the paired differences per group: ``n_pairs, estimate, ci_low, ci_high, exact_low, exact_high``.

    The estimate is the median of the means of all pairs of differences, each with itself included, and the intervals are
    two of those means at equal distance from the ends. ``ci_*`` takes its place from the normal approximation of the signed-rank
    statistic, ``exact_*`` from its exact law, where there are fewer than ``EXACT_BELOW`` differences, none of them zero and no two
    of one size; else null. Differences of zero are left out, as in ``wilcoxon_signed_rank``.
    """
    means = season_means(df, keys, pair, value, side, first, second)
    gaps = staged(means.select(*keys, (F.col("__a") - F.col("__b")).alias("__d")).where("__d IS NOT NULL"))
    kinds = gaps.groupBy(*keys, F.abs("__d").alias("__abs")).agg(F.count(F.lit(1)).alias("__n"))
    groups = staged(kinds.groupBy(*keys).agg(
        F.sum(F.when(F.col("__abs") > 0, F.col("__n")).otherwise(0)).alias("n_pairs"), (F.max("__n") > 1).alias("__tied"), (F.min("__abs") == 0).alias("__zero")))
    n = F.col("n_pairs")
    all_pairs = F.shiftright(n * (n + 1), 1)
    half = F.lit((1 - level) / 2)
    x = n.cast("double")
    near = F.greatest(F.floor(x * (x + 1) / 4 - NormalDist().inv_cdf((1 + level) / 2) * F.sqrt(x * (x + 1) * (2 * x + 1) / 24)).cast("long"), F.lit(1))
    law = signed_rank_law(groups.select(n.alias("size")))
    clean = ~F.col("__tied") & ~F.col("__zero")
    # The least sum whose chance, or that of a smaller one, reaches half of what lies outside.
    exact = F.greatest(F.size(F.filter("law", lambda p: p < half)), F.lit(1)).cast("long")
    placed = (groups.join(law, n == F.col("size"), "left").withColumn("__exact", F.when(clean & F.col("law").isNotNull(), exact)).withColumn("__near", near)
              .select(*keys, F.explode(F.map_from_arrays(
                  F.array(*[F.lit(c) for c in ("a", "b", "ci_low", "ci_high", "exact_low", "exact_high")]),
                  F.array(F.shiftright(all_pairs + 1, 1), F.shiftright(all_pairs, 1) + 1, F.col("__near"), all_pairs + 1 - F.col("__near"), F.col("__exact"), all_pairs + 1 - F.col("__exact")))).alias("name", "place")))
    found = pair_mean_statistics(gaps.where("__d <> 0"), keys, "__d", staged(placed.where("place IS NOT NULL")))
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("pair_mean")))
    wide = found.groupBy(*keys).agg(((at("a") + at("b")) / 2).alias("estimate"), *[at(c).alias(c) for c in ("ci_low", "ci_high", "exact_low", "exact_high")])
    return groups.join(wide, list(keys), "left").select(*keys, "n_pairs", "estimate", "ci_low", "ci_high", "exact_low", "exact_high")


def _two_sided(law: Column, statistic: Column, largest: Column) -> Column:
    """Twice the chance of the statistic or one farther out; the law is symmetric around half its largest value."""
    chance = F.get(law, F.least(statistic, largest - statistic).cast("int"))
    return F.when(chance.isNotNull(), F.least(2.0 * chance, F.lit(1.0)))


def signed_rank_exact(df: DataFrame, keys: Sequence[str], pair: Sequence[str], value: str = "value", side: str = "season",
                      first: str = "summer", second: str = "winter") -> DataFrame:
    """``wilcoxon_signed_rank`` with ``p_exact`` beside ``p``: from the exact law of the statistic.

    It is null from ``EXACT_BELOW`` differing pairs on, and where pairs are equal or two differences have one size.
    """
    tested = wilcoxon_signed_rank(df, keys, pair, value, side, first, second, ties=True)
    law = signed_rank_law(tested.select(F.col("n_pairs").alias("size")))
    n = F.col("n_pairs")
    clean = (F.col("n_equal_pairs") == 0) & (F.col("__ties") == 0)
    return (tested.join(law, n == F.col("size"), "left")
            .withColumn("p_exact", F.when(clean & (n < EXACT_BELOW), _two_sided(F.col("law"), F.col("v"), n * (n + 1) / 2))).drop("size", "law", "__ties"))


def rank_sum_exact(df: DataFrame, keys: Sequence[str], group: str, first: str, second: str, value: str = "value") -> DataFrame:
    """``mann_whitney`` with ``p_exact`` beside ``p``: from the exact law of U, null from ``EXACT_BELOW`` values of a group on and where two values are equal."""
    tested = staged(mann_whitney(df, keys, group, first, second, value, ties=True))
    law = rank_sum_law(tested.select(F.col("n_first").alias("first"), F.col("n_second").alias("second")))
    n1, n2 = F.col("n_first"), F.col("n_second")
    return (tested.join(law, (n1 == F.col("first")) & (n2 == F.col("second")), "left")
            .withColumn("p_exact", F.when(F.col("__ties") == 0, _two_sided(F.col("law"), F.col("u"), n1 * n2))).drop("first", "second", "law", "__ties"))


def wilcoxon_signed_rank(df: DataFrame, keys: Sequence[str], pair: Sequence[str], value: str = "value",
                         side: str = "season", first: str = "summer", second: str = "winter", ties: bool = False) -> DataFrame:
    """Paired comparison of two sides per group: the means of both sides under each pair key.

    ``n_pairs`` counts the pairs that differ; ``n_equal_pairs`` those that do not, which the test leaves out;
    ``n_only_first`` and ``n_only_second`` the pair keys one side lacks. A null in the pair key is a key of its own.
    Normal approximation with continuity and tie correction; NULL for groups without a differing pair. ``ties`` adds the sum
    of t ** 3 - t over equal sizes.
    """
    means = season_means(df, keys, pair, value, side, first, second)
    counts = means.groupBy(*keys).agg(
        F.count_if(F.col("__a") == F.col("__b")).alias("n_equal_pairs"),
        F.count_if(F.col("__b").isNull()).alias("n_only_first"), F.count_if(F.col("__a").isNull()).alias("n_only_second"))
    gaps = (means.withColumn("__d", F.col("__a") - F.col("__b")).where("__d <> 0")
            .withColumn("__abs", F.abs("__d")))
    ranked = ranked_values(gaps, keys, "__abs", [F.count(F.when(F.col("__d") > 0, 1)).alias("__up")])
    mean_rank = F.col("n_below") + (F.col("n_equal") + 1) / 2
    equal = F.col("n_equal").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.max("n_group").alias("n_pairs"), F.sum(F.col("__up") * mean_rank).alias("v"),
        F.sum(equal * equal * equal - equal).alias("__ties"))
    n = F.col("n_pairs").cast("double")
    shift = F.col("v") - n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__ties") / 48)
    tested = (sums.withColumn("z", F.try_divide(shift - F.signum(shift) * 0.5, sd))
              .withColumn("p", F.when(F.col("z").isNotNull(), F.least(2.0 * normal_upper_tail(F.abs("z")), F.lit(1.0)))))
    return (counts.join(tested, list(keys), "left")
            .select(*keys, F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "n_equal_pairs", "n_only_first", "n_only_second", "v", "z", "p", *["__ties"] * ties))


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, first: str, second: str,
                 value: str = "value", ties: bool = False) -> DataFrame:
    """Rank-sum comparison of two groups: U of the first, z with tie and continuity correction, p; ``ties`` adds the sum of t ** 3 - t over equal values."""
    rows = df.where(col(group).isin(first, second))
    ranked = ranked_values(rows, keys, value, [F.count(F.when(col(group) == first, 1)).alias("__first")])
    equal = F.col("n_equal").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("__first").alias("n_first"), F.sum(F.col("n_equal") - F.col("__first")).alias("n_second"),
        F.sum(F.col("__first") * (F.col("n_below") + (F.col("n_equal") + 1) / 2)).alias("__r"),
        F.sum(equal * equal * equal - equal).alias("__ties"))
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    n = n1 + n2
    shift = F.col("u") - n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("__ties"), n * (n - 1)), F.lit(0.0))))
    return (sums.withColumn("u", F.col("__r") - n1 * (n1 + 1) / 2)
            .withColumn("z", F.try_divide(shift - F.signum(shift) * 0.5, sd))
            .withColumn("p", F.when(F.col("z").isNotNull(), F.least(2.0 * normal_upper_tail(F.abs("z")), F.lit(1.0))))
            .drop("__r", *["__ties"] * (not ties)))


def welch_t(df: DataFrame, keys: Sequence[str], group: str, first: str, second: str, value: str = "value",
            level: float = 0.95) -> DataFrame:
    """Unequal-variance t, degrees of freedom, p and confidence interval of the mean difference."""
    def of(name: str, measure) -> Column:
        return measure(F.when(col(group) == name, col(value)))

    m = df.where(col(group).isin(first, second)).groupBy(*keys).agg(
        *[of(name, f).alias(f"{out}{i}") for i, name in ((1, first), (2, second))
          for out, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    e1 = F.try_divide(F.col("var1"), F.col("n1"))
    e2 = F.try_divide(F.col("var2"), F.col("n2"))
    diff = F.col("mean1") - F.col("mean2")
    freedom = F.try_divide((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, F.col("n1") - 1)
                           + F.try_divide(e2 * e2, F.col("n2") - 1))
    margin = student_quantile((1 + level) / 2, F.col("df")) * F.sqrt(e1 + e2)
    return (m.withColumn("difference", diff).withColumn("t", F.try_divide(diff, F.sqrt(e1 + e2)))
            .withColumn("df", freedom).withColumn("p", student_two_sided_p(F.col("t"), F.col("df")))
            .withColumn("ci_low", diff - margin).withColumn("ci_high", diff + margin))
