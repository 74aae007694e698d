"""Pair means without crossing the values with the thresholds of a round."""

from __future__ import annotations

import numpy as np

from limnos.functions import pair_means as pm


def test_no_table_holds_the_values_for_each_threshold(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values = np.unique(rng.normal(0, 1, 3000))
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    means = np.sort(((values[:, None] + values[None]) / 2)[np.triu_indices(len(values))])
    places = {"low": 1000, "middle": len(means) // 2, "high": len(means)}
    written, write = [], pm.staged
    monkeypatch.setattr(pm, "staged", lambda df: written.append(write(df)) or written[-1])
    wanted = spark.createDataFrame([(1, n, p) for n, p in places.items()], "g int, name string, place long")
    got = {r.name: r.pair_mean for r in pm.pair_mean_statistics(df, ["g"], "v", wanted, listed=500, sample_every=64).collect()}
    assert all(abs(got[n] - means[p - 1]) < 1e-12 for n, p in places.items())
    assert max(t.count() for t in written) <= len(values)


def test_the_ends_of_slices_bracket_a_place():
    rng = np.random.default_rng(1)
    values = np.sort(rng.normal(0, 5, 640).round(1))
    slices = values.reshape(20, 32)
    means = np.sort(((values[:, None] + values[None]) / 2)[np.triu_indices(len(values))])
    for place in (1, 7, len(means) // 3, len(means) - 1, len(means)):
        low, high = pm._bracket(slices[:, 0], slices[:, -1], np.full(20, 32), place, values[0] - 1.0, values[-1])
        assert (means <= low).sum() < place <= (means <= high + 1e-9).sum() and high - low < 8
