"""Trees grown in groups, so that the driver holds a bounded part of a forest."""

from __future__ import annotations

import random

from limnos.operators import models as ml


def test_the_forest_is_grown_in_groups_of_bounded_size(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, "ab"[i % 2], draw.gauss(3 * (i % 2), 1), draw.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label string, x double, y double")
    made, forest = [], ml.RandomForestClassifier
    monkeypatch.setattr(ml, "RandomForestClassifier", lambda **settings: made.append(settings) or forest(**settings))
    train, test = df.where("id < 200"), df.where("id >= 200")
    whole = ml.classify_random_forest(train, test, ["id"], "label", ["x", "y"], trees=10).collect()
    assert [m["numTrees"] for m in made] == [10]
    monkeypatch.setattr(ml, "TREE_ROWS", 800, raising=False)
    parted = ml.classify_random_forest(train, test, ["id"], "label", ["x", "y"], trees=10).collect()
    assert [m["numTrees"] for m in made[1:]] == [4, 4, 2] and len({m["seed"] for m in made[1:]}) == 3
    for found in (whole, parted):
        assert len(found) == 100 and sum(r.actual == r.predicted for r in found) > 85
