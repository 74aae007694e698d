"""Exact ranks over sliced groups, with a hot group and copies of values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.functions.draws import shuffled_position
from limnos.functions.ranks import first_k, positions, ranked_values
from limnos.functions.selection import order_statistics, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """Group a holds most rows; a third of all rows share one value of it."""
    rng = np.random.default_rng(3)
    data = [("a", float(v)) for v in rng.lognormal(0, 3, 4000).round(3)] + [("a", 1.5)] * 3000
    data += [("b", float(v)) for v in rng.integers(0, 5, 300)] + [("c", 7.0), ("c", None)]
    data += [(f"k{i}", float(i)) for i in range(50)]
    frame = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "id long, g string, v double").repartition(5)
    groups = {}
    for g, v in data:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return frame, {g: np.sort(np.array(v)) for g, v in groups.items()}


@pytest.mark.parametrize("sample_every", [1, 7, 1 << 16])
def test_ranked_values(skewed, sample_every):
    frame, groups = skewed
    got = {(r.g, r.v): (r.n_equal, r.n_below, r.n_group) for r in ranked_values(frame, ["g"], "v", sample_every=sample_every).collect()}
    want = {}
    for g, values in groups.items():
        for v in np.unique(values):
            want[(g, v)] = (int((values == v).sum()), int((values < v).sum()), len(values))
    assert got == want


@pytest.mark.parametrize("sizes", [{}, {"bins": 16, "cell_rows": 40}])
def test_quantiles(skewed, sizes):
    frame, groups = skewed
    probabilities = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.93, "q10": 1.0}
    for r in quantiles(frame, ["g"], "v", probabilities, **sizes).collect():
        for name, p in probabilities.items():
            assert r[name] == pytest.approx(np.quantile(groups[r.g], p))


def test_quantiles_of_all_rows(skewed):
    frame, groups = skewed
    everything = np.concatenate(list(groups.values()))
    assert quantiles(frame, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median(everything))


def test_selection_of_extreme_values(spark):
    """Ends that overflow a difference, values next to each other, negative zero, infinities, whole numbers beyond 2 ** 53."""
    wide = [-1.7e308, 1.7e308, 5e-324, 1e-323, 0.0, -0.0, float("inf"), float("-inf"), 1.0, 1.0 + 2 ** -52] * 7
    whole = [2 ** 60 + i for i in range(50)] + [-(2 ** 62), 2 ** 62]
    for values, kind in ((wide, "double"), (whole, "long")):
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
        places = {f"p{i}": (lambda n, i=i: F.floor(n * i / 10)) for i in range(10)}
        got = order_statistics(df, [], "v", places, bins=8, cell_rows=2).first()
        assert [got[f"p{i}"] for i in range(10)] == [sorted(values)[len(values) * i // 10] for i in range(10)]


def test_selection_neither_sorts_nor_ranks(skewed):
    frame, _ = skewed
    plan = quantiles(frame, ["g"], "v", {"m": 0.5})._jdf.queryExecution().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan and "Sort [v" not in plan


def test_positions_number_every_row(skewed):
    frame, groups = skewed
    got = {}
    for r in positions(frame.where("v is not null"), ["g"], ["v", "id"], sample_every=3).collect():
        got.setdefault(r.g, []).append((r.position, r.v, r.id, r.n_group))
    for g, values in groups.items():
        numbered = sorted(got[g])
        assert [n[0] for n in numbered] == list(range(1, len(values) + 1))
        assert [n[1] for n in numbered] == list(values)
        assert [n[1:3] for n in numbered] == sorted(n[1:3] for n in numbered)
        assert {n[3] for n in numbered} == {len(values)}


def test_shuffled_position_is_a_repeatable_permutation(skewed):
    frame, groups = skewed
    one = {r.id: r.position for r in shuffled_position(frame, ["g"], ["id"], 1).collect()}
    two = {r.id: r.position for r in shuffled_position(frame.repartition(11, "v"), ["g"], ["id"], 1).collect()}
    other = {r.id: r.position for r in shuffled_position(frame, ["g"], ["id"], 2).collect()}
    assert one == two != other
    of_a = sorted(one[i] for i in range(7000))
    assert of_a == list(range(7000))
    drawn = np.array([one[i] for i in range(4000)])
    assert abs(drawn.mean() - 3500) < 150


def test_first_k_beyond_the_window_limit(skewed):
    frame, groups = skewed
    got = first_k(frame.where("v is not null"), ["g"], ["v", "id"], 1500)
    by_group = {}
    for r in got.collect():
        by_group.setdefault(r.g, []).append(r.v)
    assert sorted(by_group["a"]) == list(groups["a"][:1500])
    assert len(by_group["b"]) == 300
