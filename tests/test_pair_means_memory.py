"""Counting pairs of slices without repeating their values for each threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from limnos.functions import pair_means as pm


def test_a_look_holds_its_batch_once():
    rng = np.random.default_rng(2)
    values = np.sort(rng.normal(0, 1, (8, 2048)).ravel()).reshape(8, 2048)
    ones = np.ones(2048, np.int64)
    thresholds = list(np.linspace(-1, 1, 24))
    pairs = [(a, b) for a in range(8) for b in range(8)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["g"] * len(pairs)), pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), pa.array([thresholds] * len(pairs)),
         *[pa.array([column for pair in pairs for column in [(values[pair[side]] if j == 0 else ones)]]) for side in (0, 1) for j in (0, 1)]],
        names=["g", "a", "b", "__ts", "__xa", "__na", "__xb", "__nb"])
    before = pa.total_allocated_bytes()
    found = []
    for out in pm._look(1)(iter([batch])):
        assert pa.total_allocated_bytes() - before < batch.nbytes / 2
        found.append(out.to_pandas())
    counted = found[0].groupby("__t")[["c", "d"]].sum()
    x = values.ravel()
    for t in thresholds:
        # Ordered pairs, and the values that pair with themselves once more.
        expected = int(np.searchsorted(x, 2 * t - x, side="right").sum() + (x <= 2 * t - x).sum())
        assert counted.loc[t].tolist() == [expected, expected]


def test_no_round_reads_the_values_for_values_alone(spark, monkeypatch):
    asked, higher = [], pm.F.aggregate
    monkeypatch.setattr(pm.F, "aggregate", lambda column, *rest: asked.append(column) or higher(column, *rest))
    values = [-3.0, -1.0, -1.0, 0.5, 2.0, 2.0, 2.0, 7.25, 9.0]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    means = sorted((a + b) / 2 for i, a in enumerate(values) for b in values[i:])
    wanted = spark.createDataFrame([(1, str(p), p) for p in range(1, len(means) + 1)], "g int, name string, place long")
    got = {r.name: r.pair_mean for r in pm.pair_mean_statistics(df, ["g"], "v", wanted, listed=2, sample_every=2).collect()}
    assert [got[str(p)] for p in range(1, len(means) + 1)] == means
    assert set(asked) == {"__means"}
