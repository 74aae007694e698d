"""Forests grown in tasks, beyond what the driver grows in a few groups."""

from __future__ import annotations

import random

import numpy as np
import pytest

from limnos.operators import models as ml


def _table(spark, n=1500):
    draw = random.Random(11)
    rows = []
    for i in range(n):
        x, y, k = draw.gauss(0, 1), draw.gauss(0, 1), float(draw.randrange(3))
        label = "abcd"[2 * (x * y > 0) + (k == 1.0)] if draw.random() < 0.95 else draw.choice("abcd")
        rows.append((i, None if i == n - 1 else label, None if i == n - 2 else x, y, k))
    return spark.createDataFrame(rows, "id long, label string, x double, y double, k double").repartition(4)


@pytest.mark.parametrize("node_rows", [500_000, 150])
def test_many_groups_of_trees_are_grown_in_tasks(spark, monkeypatch, node_rows):
    def refuse(**_):
        raise AssertionError("a tree is grown on the driver")

    monkeypatch.setattr(ml, "RandomForestClassifier", refuse)
    monkeypatch.setattr(ml, "TREE_ROWS", 100)
    monkeypatch.setattr("limnos.operators.forests.NODE_ROWS", node_rows, raising=False)
    df = _table(spark)
    found = ml.classify_random_forest(df.where("id < 1000"), df.where("id >= 1000"), ["id"], "label", ["x", "y", "k"], trees=20).collect()
    # Each complete test row once, that without a label too.
    assert sorted(r.id for r in found) == [*range(1000, 1498), 1499]
    assert [r.actual for r in found if r.id == 1499] == [None] and all(r.predicted in set("abcd") for r in found)
    assert sum(r.actual == r.predicted for r in found) > 0.85 * len(found)


def test_a_last_group_of_one_tree_compares_as_few_columns(spark, monkeypatch):
    made, forest = [], ml.RandomForestClassifier
    monkeypatch.setattr(ml, "RandomForestClassifier", lambda **settings: made.append(settings) or forest(**settings))
    monkeypatch.setattr(ml, "TREE_ROWS", 400)
    df = _table(spark, 202)
    ml.classify_random_forest(df.where("id < 200"), df.where("id >= 200"), ["id"], "label", ["x", "y", "k"], trees=3)
    assert [m["numTrees"] for m in made] == [2, 1] and {m["featureSubsetStrategy"] for m in made} == {"sqrt"}


def _plain(x, y, w, classes, depth):
    """Class counts of the leaf of each value of one feature, by a plain recursion."""
    counts = np.bincount(y, w, classes)
    best = (counts ** 2).sum() / counts.sum() * (1 + 1e-12), None
    for cut in range(31):
        left = np.bincount(y[x <= cut], w[x <= cut], classes)
        right = counts - left
        if depth and left.sum() and right.sum():
            best = max(best, ((left ** 2).sum() / left.sum() + (right ** 2).sum() / right.sum(), -cut))
    if best[1] is None:
        return dict.fromkeys(range(32), counts), True, counts
    sides = [_plain(x[side], y[side], w[side], classes, depth - 1) for side in (x <= -best[1], x > -best[1])]
    if sides[0][1] and sides[1][1] and sides[0][2].argmax() == sides[1][2].argmax():
        return dict.fromkeys(range(32), counts), True, counts
    return {v: sides[v > -best[1]][0][v] for v in range(32)}, False, counts


@pytest.mark.parametrize("depth", [0, 2, 30])
def test_a_tree_is_that_of_a_plain_recursion(depth):
    from limnos.operators.forests import grown
    rng = np.random.default_rng(5)
    x, y, w = rng.integers(0, 32, 300), rng.integers(0, 3, 300), rng.integers(1, 4, 300)
    tree = grown(x[:, None].astype(np.uint8), y, w, 3, depth, rng)
    leaves = tree.leaves(np.arange(32, dtype=np.uint8)[:, None])
    expected = _plain(x, y, w, 3, depth)[0]
    assert [tree.counts[leaf].tolist() for leaf in leaves] == [expected[v].tolist() for v in range(32)]


def test_bins_lie_between_few_values_and_share_many(spark):
    from limnos.operators.forests import feature_cuts
    df = spark.range(1000).selectExpr("array(cast(id % 3 as double), cast(id as double), 7.0D) as __x").repartition(3)
    few, many, one = feature_cuts(df, 3)
    assert few.tolist() == [0.5, 1.5] and one.tolist() == [] and len(many) == 31
    assert np.bincount(np.searchsorted(many, np.arange(1000.0))).tolist() == pytest.approx([1000 / 32] * 32, abs=1)
