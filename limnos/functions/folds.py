"""One array of numbers from all rows of a table: a partial array per task, merged in a bounded number of tasks, then in one; the driver gets one array.

Rows stay in their partitions, and what is shuffled and gathered does not grow with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks that merge the partial arrays, before one task merges theirs.
MERGERS = 16
#: Rows a task works on at once.
CHUNK = 2_048


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def fold(vectors: DataFrame, column: str, part: Callable[[np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray | None:
    """``part`` turns some rows of the vectors into an array, ``merge`` joins two of them; None for an empty table."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            x = matrix_of(batch.column(0)) if batch.num_rows else np.zeros((0, 0))
            for at in range(0, len(x), CHUNK):
                now = part(x[at:at + CHUNK])
                state = now if state is None else merge(state, now)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.list_(pa.float64()))], names=["state"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column(0)[i].values.to_numpy(zero_copy_only=False)
                state = now if state is None else merge(state, now)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.list_(pa.float64()))], names=["state"])

    kind = "state array<double>"
    merged = vectors.select(column).mapInArrow(partial, kind).repartition(MERGERS).mapInArrow(joined, kind)
    whole = merged.repartition(1).mapInArrow(joined, kind).toArrow()
    return whole["state"][0].values.to_numpy(zero_copy_only=False) if whole.num_rows else None


def moments(vectors: DataFrame, column: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean, and centred cross-products, merged without losing digits."""
    def part(x: np.ndarray) -> np.ndarray:
        mean = x.mean(axis=0)
        return np.concatenate(([len(x)], mean, ((x - mean).T @ (x - mean)).ravel()))

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = int(round((-1 + np.sqrt(4 * len(a) - 3)) / 2))  # 1 + d + d * d numbers
        n = a[0] + b[0]
        gap = b[1:d + 1] - a[1:d + 1]
        return np.concatenate(([n], a[1:d + 1] + gap * (b[0] / n), a[d + 1:] + b[d + 1:] + np.outer(gap, gap).ravel() * (a[0] * b[0] / n)))

    state = fold(vectors, column, part, merge)
    if state is None:
        return 0.0, np.zeros(0), np.zeros((0, 0))
    d = int(round((-1 + np.sqrt(4 * len(state) - 3)) / 2))
    return float(state[0]), state[1:d + 1], state[d + 1:].reshape(d, d)
