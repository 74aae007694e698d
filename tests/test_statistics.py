"""Distributions and tests against worked values."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from limnos.functions import rank_laws
from limnos.functions.normal import normal_quantile, normal_upper_tail, student_quantile, student_two_sided_p
from limnos.functions.pair_means import pair_mean_statistics
from limnos.operators import stat_tests as st


def test_normal_quantile(spark):
    ps = [1e-12, 1e-5, 0.02, 0.074, 0.076, 0.3, 0.5, 0.8, 0.97, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-12)


def test_normal_tail(spark):
    df = spark.createDataFrame([(z,) for z in (-3.0, -0.1, 0.0, 0.7, 1.96, 5.0, 7.5, 12.0)], "z double")
    for r in df.select("z", normal_upper_tail(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=1e-9)


def test_student(spark):
    df = spark.createDataFrame([(2.086, 20.0, 0.05), (12.706, 1.0, 0.05), (1.96, 1e6, 0.05), (2.845, 20.0, 0.01), (0.0, 5.0, 1.0)], "t double, df double, p double")
    for r in df.select("p", student_two_sided_p(F.col("t"), F.col("df")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=2e-3)
    q = spark.createDataFrame([(20.0,)], "df double").select(student_quantile(0.975, F.col("df"))).first()[0]
    assert q == pytest.approx(2.085963, abs=1e-5)
    low = spark.createDataFrame([(1.0, 12.7062), (2.0, 4.30265), (3.0, 3.18245), (1e6, 1.959966)], "df double, t double")
    for r in low.select("t", student_quantile(0.975, F.col("df")).alias("got")).collect():
        assert r.got == pytest.approx(r.t, abs=1e-4)


def test_welch_on_the_sleep_data(spark):
    one = [0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0]
    two = [1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4]
    df = spark.createDataFrame([("k", "1", v) for v in one] + [("k", "2", v) for v in two], "k string, g string, value double")
    r = st.welch_t(df, ["k"], "g", "1", "2").first()
    assert r.t == pytest.approx(-1.8608, abs=1e-4) and r.df == pytest.approx(17.776, abs=1e-3)
    assert r.p == pytest.approx(0.07939, abs=1e-5)
    assert (r.ci_low, r.ci_high) == (pytest.approx(-3.3654832, abs=1e-4), pytest.approx(0.2054832, abs=1e-4))


def test_mann_whitney_u(spark):
    x = [0.80, 0.83, 1.89, 1.04, 1.45, 1.38, 1.91, 1.64, 0.73, 1.46]
    y = [1.15, 0.88, 0.90, 0.74, 1.21]
    df = spark.createDataFrame([("k", "x", v) for v in x] + [("k", "y", v) for v in y], "k string, g string, value double")
    r = st.mann_whitney(df, ["k"], "g", "x", "y").first()
    assert (r.n_first, r.n_second, r.u) == (10, 5, 35.0)
    assert r.p == pytest.approx(0.2446, abs=2e-3)


def test_wilcoxon_v(spark):
    x = [1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30]
    y = [0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29]
    data = [("k", "summer", i, v) for i, v in enumerate(x)] + [("k", "winter", i, v) for i, v in enumerate(y)]
    r = st.wilcoxon_signed_rank(spark.createDataFrame(data, "k string, season string, i int, value double"), ["k"], ["i"]).first()
    assert (r.n_pairs, r.v) == (9, 40.0)
    assert r.z == pytest.approx((40 - 22.5 - 0.5) / math.sqrt(9 * 10 * 19 / 24))


def test_wilcoxon_pairs_on_the_key_and_counts_the_rest(spark):
    data = [("k", "summer", 1, 1.0), ("k", "summer", 1, 5.0), ("k", "winter", 1, 2.0), ("k", "summer", 2, 4.0),
            ("k", "winter", 3, 9.0), ("k", "winter", 4, 9.0), ("k", "summer", 5, 7.0), ("k", "winter", 5, 7.0),
            ("k", "autumn", 6, 1.0), ("k", "summer", 4, None), ("only", "summer", 1, 1.0)]
    df = spark.createDataFrame(data, "k string, season string, i int, value double")
    got = {r.k: tuple(r)[1:] for r in st.wilcoxon_signed_rank(df, ["k"], ["i"]).collect()}
    assert got["k"][:5] == (1, 1, 1, 2, 1.0)
    assert got["only"] == (0, 0, 1, 0, None, None, None)


def test_shapiro_on_the_weights(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(weights)], "k string, id int, value double")
    r = st.normality_shapiro(df, ["k"], "id").first()
    assert r.n == 11 and r.w == pytest.approx(0.7888, abs=2e-3) and r.p == pytest.approx(0.0067, abs=1e-3)


def test_shapiro_accepts_normal_scores_and_samples(spark):
    scores = [NormalDist().inv_cdf((i + 0.5) / 400) for i in range(400)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(scores)], "k string, id int, value double")
    r = st.normality_shapiro(df, ["k"], "id").first()
    assert r.w > 0.999 and r.p > 0.9


def test_shapiro_takes_all_rows_of_a_large_group(spark):
    df = spark.range(12_000).select(F.lit("k").alias("k"), "id", (F.col("id") % 1000).cast("double").alias("value"))
    r = st.normality_shapiro(df, ["k"], "id").first()
    assert r.n == 12_000 and r.w == pytest.approx(0.9549, abs=2e-3) and r.p < 1e-20


def test_dagostino_needs_eight_values(spark):
    df = spark.createDataFrame([("few", float(i)) for i in range(7)] + [("flat", float(i)) for i in range(200)], "g string, value double")
    got = {r.g: r for r in st.normality_dagostino(df, ["g"]).collect()}
    assert got["few"].k2 is None and got["few"].reject_normal is None
    assert got["flat"].reject_normal is True


def test_groups_without_spread_give_no_verdict_and_no_error(spark):
    from limnos.operators.chart_data import density_curve
    from limnos.operators.stat_tests import mann_whitney

    rows = [("one", "a", 5.0, 0)] + [("equal", g, 2.0, i) for i, g in enumerate("aabb")] + [("iqr", g, v, i) for i, (g, v) in enumerate(zip("ababab", [1, 1, 1, 1, 1, 9.0]))]
    df = spark.createDataFrame([(k, g, float(v), i) for k, g, v, i in rows], "k string, g string, value double, i long")
    found = {r.k: r for r in mann_whitney(df, ["k"], "g", "a", "b").collect()}
    assert found["one"].p is None and found["equal"].z is None and found["equal"].p is None and found["iqr"].p is not None
    assert density_curve(df, "value", ["k"], 4).where("density is null or bandwidth <= 0").count() == 0


DEPRESSION = ([1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30], [0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29])


def _paired(spark, x, y, key="k"):
    return spark.createDataFrame([(key, i, s, v) for i, p in enumerate(zip(x, y)) for s, v in zip(("summer", "winter"), p)], "k string, i int, season string, value double")


def test_exact_p_of_small_samples(spark):
    assert st.signed_rank_exact(_paired(spark, *DEPRESSION), ["k"], ["i"]).first().p_exact == pytest.approx(0.0390625, abs=1e-9)
    x = [0.80, 0.83, 1.89, 1.04, 1.45, 1.38, 1.91, 1.64, 0.73, 1.46]
    y = [1.15, 0.88, 0.90, 0.74, 1.21]
    df = spark.createDataFrame([("k", "x", v) for v in x] + [("k", "y", v) for v in y], "k string, g string, value double")
    assert st.rank_sum_exact(df, ["k"], "g", "x", "y").first().p_exact == pytest.approx(0.254412, abs=1e-6)
    tied = df.unionByName(spark.createDataFrame([("k", "x", 1.15)], df.schema))
    assert st.rank_sum_exact(tied, ["k"], "g", "x", "y").first().p_exact is None
    many = spark.range(120).select(F.lit("k").alias("k"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("g"), F.col("id").cast("double").alias("value"))
    assert st.rank_sum_exact(many, ["k"], "g", "x", "y").first().p_exact is None


def test_laws_count_every_order():
    from itertools import combinations

    for m, n in ((1, 1), (1, 5), (3, 4), (5, 2), (4, 4)):
        ways = [0] * (m * n + 1)
        for first in combinations(range(m + n), m):
            ways[sum(first) - m * (m - 1) // 2] += 1
        assert rank_laws.rank_sum_ways(m, n) == ways
    for n in range(1, 9):
        ways = [0] * (n * (n + 1) // 2 + 1)
        for mask in range(2 ** n):
            ways[sum(i + 1 for i in range(n) if mask >> i & 1)] += 1
        assert rank_laws.signed_rank_ways(n) == ways
    assert sum(rank_laws.rank_sum_ways(49, 49)) == math.comb(98, 49)


@pytest.mark.parametrize("sizes", [{}, {"parts": 8, "listed": 40, "sample_every": 5}])
def test_pair_means_against_all_pairs(spark, sizes):
    draw = random.Random(4)
    groups = {"smooth": [draw.gauss(0, 1) for _ in range(150)], "whole": [float(draw.randrange(-3, 4)) for _ in range(120)], "one": [2.5], "same": [1.25] * 40,
              "hot": [0.1] * 200 + [draw.uniform(-1e6, 1e6) for _ in range(40)], "tenths": [draw.randrange(30) / 10 for _ in range(90)], "two": [-1e-9, 1e9]}
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame([*rows, ("smooth", None), (None, 1.0)], "g string, v double").repartition(4)
    asked, want = [], {}
    for g, values in groups.items():
        means = sorted((a + b) / 2 for i, a in enumerate(values) for b in values[i:])
        for place in {1, 2, len(means) // 3, (len(means) + 1) // 2, len(means), len(means) + 1, 0}:
            asked.append((g, f"p{place}", place))
            if 1 <= place <= len(means):
                want[g, f"p{place}"] = means[place - 1]
    wanted = spark.createDataFrame(asked, "g string, name string, place long")
    got = {(r.g, r.name): r.pair_mean for r in pair_mean_statistics(df, ["g"], "v", wanted, **sizes).collect()}
    assert got == {k: pytest.approx(v, rel=1e-12, abs=1e-12) for k, v in want.items()}


def test_signed_rank_interval(spark):
    x, y = DEPRESSION
    r = st.signed_rank_interval(_paired(spark, x, y), ["k"], ["i"]).first()
    gaps = [a - b for a, b in zip(x, y)]
    means = sorted((a + b) / 2 for i, a in enumerate(gaps) for b in gaps[i:])
    # The exact law of nine differences puts the ends at the 6th mean from both sides.
    assert (r.n_pairs, r.exact_low, r.exact_high) == (9, pytest.approx(means[5]), pytest.approx(means[-6]))
    assert r.estimate == pytest.approx((means[22] + means[22]) / 2) and r.ci_low == pytest.approx(means[4])
    tied = st.signed_rank_interval(_paired(spark, x + [1.0, 2.0], y + [1.0, 1.5]), ["k"], ["i"]).first()
    assert tied.n_pairs == 10 and tied.exact_low is None and tied.ci_low is not None
    assert st.signed_rank_interval(_paired(spark, [1.0], [1.0]), ["k"], ["i"]).first().estimate is None
