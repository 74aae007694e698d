"""Random forests grown in tasks, so that no tree reaches the driver and each grows beside the others.

Features are cut into bins once. A row gets its number of draws for each tree from the tree, its block and its place in it. While a node of
a tree holds more than ``NODE_ROWS`` draws, its histograms are added up over all blocks and the driver learns its split alone; then the rows
of each node go to a task that grows the rest below it and sends the test rows of that node down. The votes are added block by block.
The law is that of Spark's forest: as many candidate bins, the square root of the columns at each node, Gini gain, nodes down to one row,
sister leaves of one class joined, and for a vote the shares of the classes in a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from limnos.functions.selection import quantiles
from limnos.session import shuffle_width, staged

#: Bins of a feature, and draws of a node whose rows one task takes.
BINS = 32
NODE_ROWS = 500_000
#: Rows of a block, and cells of the histograms that are compared at once.
BLOCK = 4_096
CELLS = 1 << 19

_PIECE = "tree int, node int, kind int, block long, x binary, y binary, w binary"


class Tree(NamedTuple):
    """Arrays over the nodes: a row with a bin above ``cut`` goes right, to ``left`` + 1; leaves have ``left`` -1. ``counts``: draws of each class."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    counts: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        node = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(self.left[node] >= 0)):
            at = node[inner]
            node[inner] = self.left[at] + (x[inner, self.feature[at]] > self.cut[at])
        return node


def _root() -> Tree:
    return Tree(np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1), np.zeros((1, 0)))


def _draws(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often a tree draws each row of a block."""
    return np.random.default_rng([seed, 0, tree, block]).poisson(1.0, n).astype(np.int64)


def _candidates(rng: np.random.Generator, nodes: int, features: int) -> np.ndarray:
    """The features that each node compares."""
    return rng.random((nodes, features)).argsort(axis=1)[:, :math.ceil(math.sqrt(features))]


def _histograms(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, candidates: np.ndarray, classes: int) -> np.ndarray:
    """Draws by node, candidate, bin and class; ``at`` numbers the rows' nodes from 0."""
    nodes, m = candidates.shape
    bins = x[np.arange(len(x))[:, None], candidates[at]]
    cells = ((at[:, None] * m + np.arange(m)) * BINS + bins) * classes + y[:, None]
    return np.bincount(cells.ravel(), np.repeat(w, m), nodes * m * BINS * classes).reshape(nodes, m, BINS, classes)


def _best(histograms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node the draws of each class, the candidate and the cut of the largest Gini gain, and whether there is a gain."""
    whole = histograms[:, 0].sum(axis=1)
    left = histograms.cumsum(axis=2)[:, :, :-1]
    right = whole[:, None, None] - left
    n_left, n_right = left.sum(axis=-1), right.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left * left).sum(axis=-1) / n_left + (right * right).sum(axis=-1) / n_right
    score = np.where((n_left > 0) & (n_right > 0), score, -np.inf).reshape(len(whole), -1)
    best, n = score.argmax(axis=1), whole.sum(axis=1)
    gain = score[np.arange(len(whole)), best] - (whole * whole).sum(axis=1) / np.maximum(n, 1)
    return whole, best // (BINS - 1), best % (BINS - 1), gain > 1e-12 * n


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, rng: np.random.Generator) -> Tree:
    """A tree over rows of bins, classes and draws, level by level."""
    at, count, made, levels = np.zeros(len(x), np.int64), 1, 0, []
    size = max(1, CELLS // (math.ceil(math.sqrt(x.shape[1])) * BINS * classes))
    for level in range(depth + 1):
        candidates, ends = _candidates(rng, count, x.shape[1]), np.searchsorted(at, np.arange(count + 1))
        counts, feature, cut, splits = np.zeros((count, classes)), np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, bool)
        for a in range(0, count, size):
            b = min(a + size, count)
            rows = slice(ends[a], ends[b])
            counts[a:b], which, cut[a:b], splits[a:b] = _best(_histograms(x[rows], y[rows], w[rows], at[rows] - a, candidates[a:b], classes))
            feature[a:b] = candidates[np.arange(a, b), which]
        splits &= level < depth
        below = 2 * (splits.cumsum() - 1)
        levels.append(Tree(feature, cut, np.where(splits, made + count + below, -1), counts))
        made, count = made + count, 2 * int(splits.sum())
        if not count:
            break
        kept = splits[at]
        x, y, w, at = x[kept], y[kept], w[kept], at[kept]
        at = below[at] + (x[np.arange(len(x)), feature[at]] > cut[at])
        order = at.argsort(kind="stable")
        x, y, w, at = x[order], y[order], w[order], at[order]
    tree = Tree(*[np.concatenate(parts) for parts in zip(*levels)])
    named, end = tree.counts.argmax(axis=1), made
    for one in reversed(levels):  # sister leaves of one class are joined, from below
        nodes = np.arange(end - len(one.left), end)
        inner = nodes[tree.left[nodes] >= 0]
        a = tree.left[inner]
        tree.left[inner[(tree.left[a] < 0) & (tree.left[a + 1] < 0) & (named[a] == named[a + 1])]] = -1
        end -= len(one.left)
    return tree


def _merged(parts: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal bins and class as one, with the sum of their draws."""
    x, y, w = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((y, *x.T))
    x, y, w = x[order], y[order], w[order]
    first = np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1) | (y[1:] != y[:-1])))
    return x[first], y[first], np.add.reduceat(w, np.flatnonzero(first))


def feature_cuts(rows: DataFrame, features: int) -> list[np.ndarray]:
    """Ends of the bins of each place of the arrays ``__x``: between its values if these are few, else at equal shares of the rows."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * features
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                seen = [s if len(s) > BINS else np.unique(np.concatenate((s, x[:, j])))[:BINS + 1] for j, s in enumerate(seen)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(features), [len(s) for s in seen]), pa.int32()), pa.array(np.concatenate(seen))], names=["j", "v"])

    # A feature with more values than bins in one task, or in all together, shows more than there are bins.
    seen = rows.select("__x").mapInArrow(few, "j int, v double").distinct().groupBy("j").agg(F.slice(F.sort_array(F.collect_list("v")), 1, BINS + 1).alias("v"))
    values = {r.j: np.array(r.v) for r in seen.collect()}
    many = [j for j, v in values.items() if len(v) > BINS]
    long = staged(rows.select(F.posexplode("__x").alias("j", "v")).where(F.col("j").isin(many)))
    ends = {r["j"]: np.unique(r[1:]) for r in quantiles(long, ["j"], "v", {f"e{i}": i / BINS for i in range(1, BINS)}).collect()} if many else {}
    return [ends[j] if j in ends else values[j][:-1] + (values[j][1:] - values[j][:-1]) / 2 for j in range(features)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _blocks(rows: DataFrame, second: str, cuts: Sequence[np.ndarray], numbered: bool) -> DataFrame:
    """``block, n, x, y``: bins of up to ``BLOCK`` consecutive rows, and their classes, or nothing where ``numbered`` rows make the block's number its first row's."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        kept = np.zeros((0, len(cuts)), np.uint8), np.zeros(0, np.int64)

        def block(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            number = int(y[0]) if numbered else (part << 32) + made
            return pa.RecordBatch.from_pydict({"block": [number], "n": [len(x)], "x": [x.tobytes()], "y": [b"" if numbered else y.astype(np.int32).tobytes()]},
                                              pa.schema([("block", pa.int64()), ("n", pa.int32()), ("x", pa.binary()), ("y", pa.binary())]))

        for batch in batches:
            if not batch.num_rows:
                continue
            kept = np.concatenate((kept[0], _binned(_matrix(batch.column(0)), cuts))), np.concatenate((kept[1], batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
            while len(kept[0]):
                # Numbers of a block follow each other.
                run = len(kept[1]) if not numbered else int(np.flatnonzero(np.diff(kept[1], append=-1) != 1)[0]) + 1
                if run == len(kept[1]) and run < BLOCK:
                    break
                run = min(run, BLOCK)
                yield block(kept[0][:run], kept[1][:run])
                kept, made = (kept[0][run:], kept[1][run:]), made + 1
        if len(kept[0]):
            yield block(*kept)

    return staged(rows.select("__x", second).mapInArrow(pack, "block long, n int, x binary, y binary"))


def _rows_of(batch: pa.RecordBatch, i: int, features: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, bins and classes of a block."""
    return (batch.column(0)[i].as_py(), np.frombuffer(batch.column(2)[i].as_py(), np.uint8).reshape(-1, features),
            np.frombuffer(batch.column(3)[i].as_py(), np.int32).astype(np.int64))


def _tops(blocks: DataFrame, rows: int, features: int, classes: int, trees: int, depth: int, seed: int, pieces: int) -> tuple[list[Tree], dict[tuple[int, int], int]]:
    """The upper part of each tree, down to nodes of at most ``NODE_ROWS`` draws or without a gain, and the depth of these nodes."""
    tops = [_root() for _ in range(trees)]
    depths = {(t, 0): 0 for t in range(trees)}
    open_ = list(depths) if rows > NODE_ROWS and depth > 0 else []
    while open_:
        asked: dict[int, list[int]] = {}
        for t, node in open_:
            asked.setdefault(t, []).append(node)
        chosen = {(t, node): _candidates(np.random.default_rng([seed, 1, t, node]), 1, features) for t, node in open_}
        upper = list(tops)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    block, x, y = _rows_of(batch, i, features)
                    for t, nodes in asked.items():
                        w, at = _draws(seed, t, block, len(x)), upper[t].leaves(x)
                        for node in nodes:
                            here = (at == node) & (w > 0)
                            if here.any():
                                found = _histograms(x[here], y[here], w[here], np.zeros(int(here.sum()), np.int64), chosen[t, node], classes)
                                sums[t, node] = sums[t, node] + found if (t, node) in sums else found
            for (t, node), s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([node], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["tree", "node", "h"])

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (t, node), parts in _grouped(batches, 2):
                total = sum(np.frombuffer(p[0].as_py()) for p in parts)
                shape = (1, chosen[t, node].shape[1], BINS, classes)
                _, which, cut, gains = _best(total.reshape(shape))
                if gains[0]:
                    low = float(total.reshape(shape)[0, which[0], :cut[0] + 1].sum())
                    yield pa.RecordBatch.from_pydict({"tree": [t], "node": [node], "feature": [int(chosen[t, node][0, which[0]])], "cut": [int(cut[0])],
                                                      "low": [low], "high": [float(total.reshape(shape)[0, 0].sum()) - low]},
                                                     pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))

        counted = blocks.repartition(pieces, "block").mapInArrow(count, "tree int, node int, h binary")
        summed = counted.repartition(min(len(open_), pieces), "tree", "node").sortWithinPartitions("tree", "node")
        open_ = []
        for r in sorted(summed.mapInArrow(decide, "tree int, node int, feature int, cut int, low double, high double").collect()):
            top, below = tops[r.tree], depths.pop((r.tree, r.node)) + 1
            made = len(top.left)
            feature, cut, left = (np.concatenate((a, np.full(2, fill))) for a, fill in ((top.feature, 0), (top.cut, 0), (top.left, -1)))
            feature[r.node], cut[r.node], left[r.node] = r.feature, r.cut, made
            tops[r.tree] = Tree(feature, cut, left, np.zeros((made + 2, 0)))
            for node, n in ((made, r.low), (made + 1, r.high)):
                depths[r.tree, node] = below
                if n > NODE_ROWS and below < depth:
                    open_.append((r.tree, node))
    return tops, depths


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[list]]]:
    """Sorted rows as runs of equal keys, one after the other: the keys, and the other cells of each row."""
    rows = ((tuple(c[i].as_py() for c in batch.columns[:n_keys]), [c[i] for c in batch.columns[n_keys:]]) for batch in batches for i in range(batch.num_rows))
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def run() -> Iterator[list]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1]
                row = next(rows, None)

        yield key, (parts := run())
        for _ in parts:
            pass


def forest_winners(train: DataFrame, cuts: Sequence[np.ndarray], test: DataFrame, rows: int, classes: int, trees: int, depth: int, seed: int) -> DataFrame:
    """``__row, __winner``: the class, from 0, with the most votes for each test row.

    ``train`` has the features ``__x`` and the class ``__label`` of about ``rows`` rows; its partitions and their order follow from the rows.
    ``test`` is a written table with ``__x`` and the number ``__row``, which is its own for each row and rises by one along a file.
    """
    features, width = len(cuts), shuffle_width(train.sparkSession)
    pieces = max(1, min(-(-rows // BLOCK), width))
    blocks, tested = _blocks(train, "__label", cuts, False), _blocks(test, "__row", cuts, True)
    tops, depths = _tops(blocks, rows, features, classes, trees, depth, seed, pieces)

    def spread(kind: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block, x, y = _rows_of(batch, i, features)
                    out: list[tuple] = []
                    for t, top in enumerate(tops):
                        w = np.ones(len(x), np.int64) if kind else _draws(seed, t, block, len(x))
                        at = top.leaves(x)
                        for node in np.unique(at[w > 0]):
                            here = np.flatnonzero((at == node) & (w > 0))
                            second = here if kind else y[here]
                            out.append((t, int(node), kind, block, x[here].tobytes(), second.astype(np.int32).tobytes(), b"" if kind else w[here].astype(np.int32).tobytes()))
                    if not out:
                        continue
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tree", "node", "kind", "block", "x", "y", "w"])
        return send

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, node), parts in _grouped(batches, 2):
            held, size, tree = [], 0, None
            limit = NODE_ROWS
            for kind, block, x, y, w in parts:
                x, y = np.frombuffer(x.as_py(), np.uint8).reshape(-1, features), np.frombuffer(y.as_py(), np.int32)
                if not kind.as_py():
                    held.append((x, y.astype(np.int64), np.frombuffer(w.as_py(), np.int32).astype(np.int64)))
                    size += len(x)
                    if size > limit:  # a node that no cut divides holds few kinds of rows
                        held = [_merged(held)]
                        size, limit = len(held[0][0]), max(limit, 2 * len(held[0][0]))
                    continue
                if tree is None:
                    tree = grown(*_merged(held), classes, depth - depths[t, node], np.random.default_rng([seed, 2, t, node]))
                    held, votes = [], tree.counts / tree.counts.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([t], pa.int32()), pa.array([y.tobytes()], pa.binary()),
                                                  pa.array([votes[tree.leaves(x)].tobytes()], pa.binary())], names=["block", "tree", "at", "votes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), parts in _grouped(batches, 1):
            votes = np.zeros((BLOCK, classes))
            seen = 0
            for _, at, given in parts:  # in the order of the trees
                places = np.frombuffer(at.as_py(), np.int32)
                votes[places] += np.frombuffer(given.as_py()).reshape(-1, classes)
                seen = max(seen, int(places[-1]) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(block + np.arange(seen), pa.int64()), pa.array(votes[:seen].argmax(axis=1), pa.int32())], names=["__row", "__winner"])

    sent = blocks.repartition(pieces, "block").mapInArrow(spread(0), _PIECE).unionByName(tested.repartition(width, "block").mapInArrow(spread(1), _PIECE))
    voted = (sent.repartition(max(1, min(len(depths), 4 * width)), "tree", "node").sortWithinPartitions("tree", "node", "kind", "block")
             .mapInArrow(grow, "block long, tree int, at binary, votes binary"))
    return staged(voted.repartition(width, "block").sortWithinPartitions("block", "tree").mapInArrow(add, "__row long, __winner int"))
