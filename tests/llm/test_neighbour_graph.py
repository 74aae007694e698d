"""The graph index against all cosines."""

from __future__ import annotations

import math

import numpy as np
import pytest

from limnos.llm import neighbour_graph
from limnos.llm.neighbour_graph import build, build_graph, directions, exact_cosines, search, search_graph

SCHEMA = "vec_id long, embedding array<double>, label int, name string, size int, shard long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def all_pairs(rows, queries, k):
    """Nearest of every query among all rows of other ids, ties to the smaller id."""
    points = [(i, v) for i, v in rows if good(v)]
    out = []
    for q, v in dict.fromkeys((q, tuple(v)) for q, v in queries if good(v)):
        scored = [(float(exact_cosines(np.array([v]), np.array([w]))[0]), i) for i, w in points if i != q and len(w) == len(v)]
        scored.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found(index, spark, queries, k=5):
    return sorted([tuple(r) for r in search(index, frame(spark, queries), k).collect()], key=str)


def test_awkward_vectors_in_many_shards(spark):
    draw = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(draw.normal(size=(300, 4)).tolist())]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(200)] + [(5000 + i, [2.0, 4.0, 6.0, 8.0]) for i in range(3)]  # copies, and ties by direction
    rows += [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [None, 1.0, 1.0, 1.0]), (2004, [math.nan] * 4), (2005, [math.inf, 1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.0]),
             (2006, [1e200, 2e200, 1e200, 1e200]), (2007, [1e-200, 2e-200, 1e-200, 1e-200]), (2008, [1.0, 2.0]), (2009, [1.0, 2.5]), (2010, [3.0]), (7, rows[7][1])]
    queries = [r for r in rows if r[0] is None or r[0] % 25 == 0 or r[0] > 2000]
    index = build(frame(spark, rows), shard_rows=60)
    assert index.count() > 5
    assert found(index, spark, queries) == all_pairs(rows, queries, 5)


def test_recall_and_flat_arrays():
    points = directions(np.random.default_rng(4).normal(size=(3000, 32)))
    graph = build_graph(points)
    assert [x.shape for x in graph.links] == [(len(n), 2 * neighbour_graph.LINKS if l == 0 else neighbour_graph.LINKS) for l, n in enumerate(graph.nodes)]
    assert len(graph.nodes) > 1 and all((np.diff(n) > 0).all() for n in graph.nodes)
    scores = points[:200] @ points.T
    exact = np.argsort(-scores, axis=1)[:, :10]
    near = search_graph(graph, points[:200], 64)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near.tolist(), exact.tolist())]) > 0.9
    # The upper levels are needed to get there in few steps, and each node reaches others.
    assert (graph.links[0][:, 0] >= 0).all()


def test_distant_clusters_are_reached():
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(30, 16)) * 20
    points = directions(np.concatenate([c + draw.normal(size=(60, 16)) * 0.05 for c in centres])[draw.permutation(1800)])
    scores = points[:300] @ points.T
    near = search_graph(build_graph(points), points[:300], 96)[:, :5]
    best = np.sort(scores, axis=1)[:, ::-1][:, :5]
    mine = np.take_along_axis(scores, near, axis=1)
    assert np.mean(np.abs(mine - best) < 1e-6) > 0.9


@pytest.mark.parametrize("count", [1, 2, 33, 70])
def test_small_graphs_find_every_node(count):
    points = directions(np.random.default_rng(count).normal(size=(count, 8)))
    assert sorted(search_graph(build_graph(points), points[:1])[0][:count].tolist()) == list(range(count))


def test_empty_tables(spark):
    nothing = frame(spark, [])
    some = frame(spark, [(1, [1.0, 0.0])])
    assert search(build(nothing), some, 5).count() == 0
    assert search(build(some), nothing, 5).count() == 0
    assert search(build(some), some, 5).count() == 0
