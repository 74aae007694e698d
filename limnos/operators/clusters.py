"""k-means and Gaussian mixtures, all starts and numbers of clusters in one pass a round.

A round reads the table once, on its own partitions: the centres of every fit still moving are small arrays sent to the tasks, and each
task returns one array of sums for all of them. Starting rows are drawn by a digest of the vector, so a seed means the same rows on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.draws import draw
from limnos.functions.folds import fold, moments
from limnos.functions.nulls import col

#: Squared shift of a centre, relative to the spread of the data, under which a fit stands still.
STILL = 1e-12
#: Least eigenvalue of a mixture's covariance, relative to the mean variance of the data.
FLOOR = 1e-6


class Fit(NamedTuple):
    """Centres, and the sum of squared distances of the rows to their nearest centre."""
    centres: np.ndarray
    within: float


def starting_rows(vectors: DataFrame, column: str, wanted: int, seed: int) -> np.ndarray:
    """Up to ``wanted`` distinct vectors in the order of a draw."""
    spot = draw(seed, F.array_join(F.transform(col(column), lambda x: x.cast("string")), ","))
    kinds = vectors.select(F.approx_count_distinct(spot)).first()[0]
    share = min(1.0, 8.0 * wanted / max(kinds, 1))
    def first(part: DataFrame) -> list:
        return part.groupBy("__spot").agg(F.first(col(column)).alias("v")).orderBy("__spot").limit(wanted).collect()

    spotted = vectors.select(col(column), spot.alias("__spot"))
    rows = first(spotted.where(F.col("__spot") <= int(share * 2.0 ** 60)))
    if len(rows) < wanted and share < 1:
        rows = first(spotted)
    return np.array([r["v"] for r in rows], float)


def kmeans_fits(vectors: DataFrame, column: str, ks: Iterable[int], starts: int = 10, seed: int = 1, max_iter: int = 100) -> dict[int, Fit]:
    """The best of several starts for each number of clusters, by the sum of squared distances.

    ``vectors`` should be a written table of arrays without nulls. With fewer distinct rows than clusters, clusters
    share a centre and the later ones stay empty. An empty table gives no fits.
    """
    ks = list(ks)
    rows = starting_rows(vectors, column, starts * max(ks), seed)
    if not len(rows):
        return {}
    order = np.random.default_rng(seed)
    mean = rows.mean(axis=0)
    scale = max(float(((rows - mean) ** 2).sum(axis=1).mean()), 1e-300)
    names = [(k, s) for k in ks for s in range(starts)]
    centres = {(k, s): rows[np.resize(np.roll(np.arange(len(rows)), -s * k) if len(rows) >= starts * k else order.permutation(len(rows)), k)] for k, s in names}
    within: dict[tuple[int, int], float] = {}
    moving = names
    for i in range(max_iter):
        sums = fold(vectors, column, _assign_part([centres[m] for m in moving], mean))
        at, still = 0, []
        for m in moving:
            k, d = centres[m].shape
            block = sums[at:at + k * (d + 1) + 1]
            at += len(block)
            counts, totals = block[1:k + 1], block[k + 1:].reshape(k, d)
            new = np.where(counts[:, None] > 0, totals / np.maximum(counts, 1)[:, None] + mean, centres[m])
            within[m] = float(block[0])
            if ((new - centres[m]) ** 2).sum(axis=1).max() <= STILL * scale or i == max_iter - 1:
                still.append(m)  # the centres the rows were last dealt to stay, so that ``within`` is theirs
            else:
                centres[m] = new
        moving = [m for m in moving if m not in still]
        if not moving:
            break
    best = {k: min((m for m in names if m[0] == k), key=lambda m: (within[m], m)) for k in ks}
    return {k: Fit(centres[m], within[m]) for k, m in best.items()}


def _assign_part(fits: list[np.ndarray], origin: np.ndarray):
    """For each fit: sum of squared distances, rows of each centre, and their sums from ``origin``."""
    centres = [c - origin for c in fits]

    def part(x: np.ndarray) -> np.ndarray:
        x = x - origin
        squares = (x * x).sum(axis=1)
        out = []
        for c in centres:
            gaps = squares[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
            near = gaps.argmin(axis=1)
            mine = np.zeros((len(c), len(x)))
            mine[near, np.arange(len(x))] = 1.0
            out += [[((x - c[near]) ** 2).sum()], mine.sum(axis=1), (mine @ x).ravel()]
        return np.concatenate(out)
    return part


def nearest_centre(vector: Column, centres: np.ndarray) -> Column:
    """Number of the nearest centre, the first on a tie; computed where the row is."""
    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_list()).astype(float) if len(v) else np.zeros((0, centres.shape[1]))
        return pd.Series(np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1).argmin(axis=1).astype("int32"))
    return nearest(vector)


def silhouettes(vectors: DataFrame, column: str, labellers: list) -> list[float | None]:
    """Mean silhouette with squared distances of each clustering, a function of a matrix of rows to cluster numbers; None for one cluster.

    One pass sums each cluster, a second compares every row with those sums: the mean squared distance to a cluster
    follows from its size, its sum and its sum of squares. A row alone in its cluster counts 0.
    """
    sizes = [k for k, _ in labellers]

    def tally(x: np.ndarray) -> np.ndarray:
        squares, out = (x * x).sum(axis=1), []
        for k, label in labellers:
            mine = np.zeros((k, len(x)))
            mine[label(x), np.arange(len(x))] = 1.0
            out += [mine.sum(axis=1), mine @ squares, (mine @ x).ravel()]
        return np.concatenate(out)

    sums = fold(vectors, column, tally)
    if sums is None:
        return [None] * len(sizes)
    d = (len(sums) - 2 * sum(sizes)) // sum(sizes)
    tallies, at = [], 0
    for k in sizes:
        tallies.append((sums[at:at + k], sums[at + k:at + 2 * k], sums[at + 2 * k:at + (2 + d) * k].reshape(k, d)))
        at += (2 + d) * k

    def score(x: np.ndarray) -> np.ndarray:
        squares, rows, out = (x * x).sum(axis=1), np.arange(len(x)), []
        for (k, label), (n, sq, total) in zip(labellers, tallies):
            own = label(x)
            mean = squares[:, None] + (sq / np.maximum(n, 1)) - 2 * (x @ (total / np.maximum(n, 1)[:, None]).T)
            a = np.maximum(mean[rows, own], 0) * n[own] / np.maximum(n[own] - 1, 1)
            other = np.where(n > 0, mean, np.inf)
            other[rows, own] = np.inf
            b = np.maximum(other.min(axis=1), 0)
            b = np.where(np.isfinite(b), b, a)  # no other cluster
            high = np.maximum(a, b)
            out.append(np.where((n[own] > 1) & (high > 0), (b - a) / np.where(high > 0, high, 1), 0.0).sum())
        return np.array([len(x), *out])

    total = fold(vectors, column, score)
    return [float(t / total[0]) if (n > 0).sum() > 1 else None for t, (n, _, _) in zip(total[1:], tallies)]


def labels_of(centres: np.ndarray):
    return len(centres), lambda x: np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1).argmin(axis=1)


class Mixture(NamedTuple):
    """Weights, means and covariances of the components."""
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows by components."""
        out = []
        for w, mean, cov in zip(self.weights, self.means, self.covariances):
            root = np.linalg.cholesky(cov)
            z = np.linalg.solve(root, (x - mean).T)
            out.append(math.log(max(w, 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * len(mean) * math.log(2 * math.pi))
        return np.stack(out, axis=1)


def _floored(covariance: np.ndarray, floor: float) -> np.ndarray:
    """The likeliest covariance without an eigenvalue under the floor."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def _expect_part(mixtures: list[Mixture | None], labels: list, origin: np.ndarray):
    """For each mixture: log-likelihood, then weight, sum and cross-products from ``origin`` of each component."""
    def part(x: np.ndarray) -> np.ndarray:
        out, y = [], x - origin
        for mixture, (k, label) in zip(mixtures, labels):
            if mixture is None:  # the first round deals the rows to the centres
                share, total = np.zeros((len(x), k)), 0.0
                share[np.arange(len(x)), label(x)] = 1.0
            else:
                joint = mixture.log_joint(x)
                top = joint.max(axis=1, keepdims=True)
                each = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
                share, total = np.exp(joint - each[:, None]), each.sum()
            out += [[total], share.sum(axis=0), (share.T @ y).ravel(), np.einsum("nk,ni,nj->kij", share, y, y, optimize=True).ravel()]
        return np.concatenate(out)
    return part


def mixture_fits(vectors: DataFrame, column: str, ks: Iterable[int], starts: int = 10, seed: int = 1, max_iter: int = 100,
                 tolerance: float = 1e-3) -> tuple[float, dict[int, tuple[Mixture, list[float]]]]:
    """Rows, and for each k the mixture with the log-likelihood of every round, which never falls.

    Expectation-maximisation from the best k-means clusters, until a round gains less than ``tolerance``. Responsibilities are taken through logarithms. A covariance
    has no eigenvalue under ``FLOOR`` times the mean variance of the data (1 where all rows are equal), so one of a constant column or of few rows is not
    singular; of all such covariances it is the likeliest.
    """
    n, mean, squares = moments(vectors, column)
    if not n:
        return 0.0, {}
    variance = float(np.trace(squares)) / n / len(mean)
    floor = FLOOR * (variance if variance > 0 else 1.0)
    groups = kmeans_fits(vectors, column, ks, starts, seed)
    labels = {k: labels_of(f.centres) for k, f in groups.items()}
    now: dict[int, Mixture | None] = dict.fromkeys(groups)
    seen: dict[int, list[float]] = {k: [] for k in groups}
    kept: dict[int, Mixture] = {}
    moving = list(groups)
    for i in range(max_iter + 1):
        sums, at = fold(vectors, column, _expect_part([now[k] for k in moving], [labels[k] for k in moving], mean)), 0
        still, d = [], len(mean)
        for k in moving:
            block = sums[at:at + 1 + k * (1 + d + d * d)]
            at += len(block)
            if now[k] is not None:
                seen[k].append(float(block[0]))
                kept[k] = now[k]
                if i == max_iter or len(seen[k]) > 1 and seen[k][-1] - seen[k][-2] < tolerance:
                    still.append(k)
                    continue
            weight, total, cross = block[1:k + 1], block[k + 1:k + 1 + k * d].reshape(k, d), block[k + 1 + k * d:].reshape(k, d, d)
            safe = np.maximum(weight, 1e-300)[:, None]
            means = total / safe
            covariances = [_floored(c / max(w, 1e-300) - np.outer(m, m), floor) if w > 1e-8 else np.eye(d) * max(variance, floor) for w, m, c in zip(weight, means, cross)]
            now[k] = Mixture(weight / n, np.where(weight[:, None] > 1e-8, means, 0.0) + mean, np.array(covariances))
        moving = [k for k in moving if k not in still]
        if not moving:
            break
    return n, {k: (kept[k], seen[k]) for k in groups}
