"""Copies that the neighbour search makes where no bound prunes."""

from __future__ import annotations

import numpy as np

from limnos.operators import neighbours as nn


def test_queries_are_not_copied_for_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (900, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, features array<double>")
    written, write = [], nn.staged
    monkeypatch.setattr(nn, "staged", lambda df: written.append(write(df)) or written[-1])
    monkeypatch.setattr(nn, "TRAIN_BLOCK", 200)
    found = nn.nearest_neighbours(df, df.withColumnRenamed("id", "train_id"), 5, "id", "train_id").collect()
    got = {(r.id, r["rank"]): r.train_id for r in found}
    for i, v in enumerate(vectors):
        near = np.argsort(((vectors - v) ** 2).sum(axis=1), kind="stable")[:5]
        assert [got[i, r] for r in range(1, 6)] == near.tolist()
    assert max(t.count() for t in written) <= 900


def test_shards_and_blocks_are_bounded():
    for rows in (10, 5_000, 300_000, 3_000_000):
        shards, blocks = nn._grid(rows, rows, 528, 6, 48)
        assert rows * 528 / shards <= nn.BLOCK_BYTES * 1.01 and rows * 528 / blocks <= nn.BLOCK_BYTES * 1.01 and shards * blocks <= max(96, 4 * (rows * 528 / nn.BLOCK_BYTES + 1) ** 2)
    held = np.array([3.0, 0, 50, 1, 1, 1])
    first, last = nn._shards_of(held, 4)
    assert (first <= last).all() and first[0] == 0 and last[-1] == 3 and last[2] - first[2] >= 2
