"""Clustering and projection over folded arrays, classification with Spark ML.

Initialisation, solver and loss differ from other libraries, so results agree in kind, not digit by
digit. The silhouette uses squared Euclidean distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.folds import moments
from limnos.functions.nulls import col, drop_null_rows
from limnos.operators.clusters import kmeans_fits, labels_of, mixture_fits, nearest_centre, silhouettes
from limnos.operators.forests import feature_cuts, forest_winners
from limnos.session import staged

# Rows of a partition that the classifiers are fitted to. The number of partitions follows from the rows alone, so that a seed draws the
# same rows on every cluster.
FIT_ROWS = 50_000
# Rows times trees of a forest that are grown at once, and times that the driver grows as many, before a forest is grown in tasks.
TREE_ROWS = 400_000
GROUPS = 4


def assembled(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Complete rows with the columns as one vector."""
    inputs = [f"__f{i}" for i in range(len(columns))]
    numbered = drop_null_rows(df, columns).select("*", *[col(c).alias(n) for c, n in zip(columns, inputs)])
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(numbered).drop(*inputs)


def expand_array(df: DataFrame, column: str, size: int, prefix: str = "x") -> DataFrame:
    """Array elements as columns x0, x1, ..."""
    return df.select(*[c for c in df.columns if c != column],
                     *[col(column)[i].cast("double").alias(f"{prefix}{i}") for i in range(size)])


def fit_input(df: DataFrame) -> DataFrame:
    """Training rows computed once, placed by a hash of the row and sorted in each partition.

    The estimators cache what they iterate over, and release it.
    """
    row = ["__vector", *[c for c in df.columns if c != "features"]]
    rows = staged(df)
    partitions = max(1, -(-rows.count() // FIT_ROWS))
    placed = rows.withColumn("__vector", vector_to_array("features"))
    return placed.repartition(partitions, *[col(c) for c in row]).sortWithinPartitions(*[col(c) for c in row]).drop("__vector")


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Complete rows, written once, with the columns as the array ``__x``."""
    return staged(drop_null_rows(df, columns).withColumn("__x", F.array(*[col(c).cast("double") for c in columns])))


def kmeans(df: DataFrame, columns: Sequence[str], k: int, starts: int = 10, seed: int = 1) -> DataFrame:
    """Rows with their cluster number, 0-based: the best of several starts, each row at its nearest centre."""
    rows = _vectors(df, columns)
    fits = kmeans_fits(rows, "__x", [k], starts, seed)
    cluster = nearest_centre(F.col("__x"), fits[k].centres) if fits else F.lit(None).cast("int")
    return rows.withColumn("cluster", cluster).drop("__x")


def kmeans_sweep(df: DataFrame, columns: Sequence[str], ks: Iterable[int] = range(2, 15), starts: int = 10,
                 seed: int = 1) -> DataFrame:
    """Silhouette and within-cluster sum of squares per number of clusters."""
    rows = _vectors(df, columns)
    fits = kmeans_fits(rows, "__x", ks, starts, seed)
    scores = silhouettes(rows, "__x", [labels_of(f.centres) for f in fits.values()]) if fits else []
    out = [(k, s, f.within) for (k, f), s in zip(fits.items(), scores)]
    return df.sparkSession.createDataFrame(out, "k int, silhouette double, within_ss double")


def gmm_sweep(df: DataFrame, columns: Sequence[str], ks: Iterable[int] = range(1, 13), seed: int = 1, max_iter: int = 100) -> DataFrame:
    """Full-covariance mixtures: log-likelihood, AIC, BIC and silhouette; the least BIC is marked best."""
    rows, d = _vectors(df, columns), len(columns)
    n, fits = mixture_fits(rows, "__x", ks, seed=seed, max_iter=max_iter)
    scores = silhouettes(rows, "__x", [(k, lambda x, m=m: m.log_joint(x).argmax(axis=1)) for k, (m, _) in fits.items()]) if fits else []
    out = []
    for (k, (_, seen)), silhouette in zip(fits.items(), scores):
        free = k - 1 + k * d + k * d * (d + 1) // 2
        out.append((k, seen[-1], 2.0 * free - 2.0 * seen[-1], free * math.log(n) - 2.0 * seen[-1], silhouette))
    least = min((r[3] for r in out), default=None)
    return df.sparkSession.createDataFrame([(*r, r[3] == least) for r in out],
                                           "k int, log_likelihood double, aic double, bic double, silhouette double, best boolean")


def _components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the variance and loadings (columns by components), the largest first.

    The sign of a component, which is open, makes its largest loading positive.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    total = values.sum()
    return values / total if total > 0 else values, vectors * np.where(signs == 0, 1, signs)


def _projected(x: Column, mean: np.ndarray, weights: np.ndarray) -> list[Column]:
    """Each component of an array column."""
    return [sum(((F.get(x, F.lit(j)) - float(m)) * float(w) for j, (m, w) in enumerate(zip(mean, column))), F.lit(0.0)) for column in weights.T]


def _scales(n: float, squares: np.ndarray, scale: bool) -> np.ndarray:
    """Divisors of the columns: the sd with n - 1 on request; a constant column is left as it is."""
    sd = np.sqrt(np.diag(squares) / max(n - 1, 1))
    return np.where(sd > 0, sd, 1.0) if scale else np.ones(len(sd))


def pca(df: DataFrame, columns: Sequence[str], k: int, scale: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores per row (PC1..PCk), explained-variance ratio per component, loadings per column.

    One aggregate gives the centred cross-products; scores are a column expression, computed where the rows are. A constant column has no loading.
    An empty table gives no scores, ratios or loadings.
    """
    rows = _vectors(df, columns)
    n, mean, squares = moments(rows, "__x")
    keep, spark = [c for c in df.columns if c not in columns], df.sparkSession
    names = [f"PC{i + 1}" for i in range(k)]
    loads = f"feature string, {', '.join(f'{c} double' for c in names)}"
    if not n:
        return (rows.select(*keep, *[F.lit(0.0).alias(c) for c in names]), spark.createDataFrame([], "component int, variance_ratio double"),
                spark.createDataFrame([], loads))
    scales = _scales(n, squares, scale)
    shares, weights = _components(squares / max(n - 1, 1) / np.outer(scales, scales))
    scores = rows.select(*keep, *[c.alias(name) for c, name in zip(_projected(F.col("__x"), mean, weights[:, :k] / scales[:, None]), names)])
    ratios = [(i + 1, float(r)) for i, r in enumerate(shares[:k])]
    return (scores, spark.createDataFrame(ratios, "component int, variance_ratio double"),
            spark.createDataFrame([(c, *map(float, row)) for c, row in zip(columns, weights[:, :k])], loads))


def cluster_projection(df: DataFrame, columns: Sequence[str], ids: Sequence[str], clusters: int, components: int = 3,
                       starts: int = 10, seed: int = 1, scale: bool = True) -> DataFrame:
    """Ids, cluster and first components of every row, over the same centred and scaled vectors."""
    rows = _vectors(df, columns)
    n, mean, squares = moments(rows, "__x")
    if not n:
        return rows.select(*ids, F.lit(0).alias("cluster"), *[F.lit(0.0).alias(f"PC{i + 1}") for i in range(components)])
    scales = _scales(n, squares, scale)
    scaled = staged(rows.select(*ids, F.array(*[(F.get("__x", F.lit(j)) - float(m)) / float(s) for j, (m, s) in enumerate(zip(mean, scales))]).alias("__x")))
    centres = kmeans_fits(scaled, "__x", [clusters], starts, seed)[clusters].centres
    _, weights = _components(squares / max(n - 1, 1) / np.outer(scales, scales))
    projected = _projected(F.col("__x"), np.zeros(len(mean)), weights[:, :components])
    return scaled.select(*ids, nearest_centre(F.col("__x"), centres).alias("cluster"), *[c.alias(f"PC{i + 1}") for i, c in enumerate(projected)])


def _named(df: DataFrame, ids: Sequence[str], label: str) -> DataFrame:
    return df.select(*ids, col(label).cast("string").alias("actual"), "features")


def _label_index(train: DataFrame):
    return StringIndexer(inputCol="actual", outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)


def _fit_and_predict(train: DataFrame, test: DataFrame, ids: Sequence[str], label: str, estimator) -> DataFrame:
    train = staged(_named(train, ids, label))
    index = _label_index(train)
    model = estimator.fit(fit_input(index.transform(train)))
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return names.transform(model.transform(_named(test, ids, label))).select(*ids, "actual", "predicted")


def classify_linear_svc(train: DataFrame, test: DataFrame, ids: Sequence[str], label: str, columns: Sequence[str],
                        reg: float = 1e-3, max_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """Linear support vectors, one class against the rest (hinge loss)."""
    svc = OneVsRest(labelCol="__label", classifier=LinearSVC(regParam=reg, maxIter=max_iter, tol=tol), parallelism=4)
    return _fit_and_predict(assembled(train, columns), assembled(test, columns), ids, label, svc)


def classify_random_forest(train: DataFrame, test: DataFrame, ids: Sequence[str], label: str, columns: Sequence[str],
                           trees: int = 100, depth: int = 30, seed: int = 1) -> DataFrame:
    """Random forest; Spark limits the depth to 30.

    Trees are grown ``TREE_ROWS`` rows times trees at once, and their votes added to the test rows, so that the driver never holds more of the
    forest than that. Tasks keep the node of each row instead of being sent the trees again for every level. A forest of more than ``GROUPS``
    such groups is grown in tasks, each tree beside the others.
    """
    train = staged(_named(assembled(train, columns), ids, label))
    index = _label_index(train)
    indexed, n, labels = index.transform(train), train.count(), F.lit(list(index.labels))
    tested = _named(assembled(test, columns), ids, label)
    if n * trees > GROUPS * TREE_ROWS:
        x = vector_to_array("features").alias("__x")
        tested = staged(tested.select(*ids, "actual", x, F.monotonically_increasing_id().alias("__row")))
        winners = forest_winners(fit_input(indexed).select(x, "__label"), feature_cuts(indexed.select(x), len(columns)), tested, n, len(index.labels), trees, depth, seed)
        return tested.join(winners, "__row").select(*ids, "actual", F.element_at(labels, F.col("__winner") + 1).alias("predicted"))
    rows = fit_input(indexed).persist()
    group = max(1, min(trees, TREE_ROWS // max(1, n)))
    voted = tested.withColumn("__votes", F.array_repeat(F.lit(0.0), len(index.labels)))
    # By itself Spark would give a last group of one tree all columns at each node.
    subset = "sqrt" if trees > 1 else "auto"
    for first in range(0, trees, group):
        forest = RandomForestClassifier(labelCol="__label", numTrees=min(group, trees - first), maxDepth=depth, seed=seed + first, cacheNodeIds=True, featureSubsetStrategy=subset)
        model = forest.fit(rows)
        votes = vector_to_array("rawPrediction")
        voted = staged(model.transform(voted).select(*ids, "actual", "features", F.zip_with("__votes", votes, lambda a, b: a + b).alias("__votes")))
        del model
    rows.unpersist()
    winner = F.array_position("__votes", F.array_max("__votes")).cast("int")
    return voted.select(*ids, "actual", F.element_at(labels, winner).alias("predicted"))


def fourier_features(columns: Sequence[str], gamma: float, size: int, seed: int) -> Column:
    """Random cosine features whose dot products approach the Gaussian kernel exp(-gamma * d^2)."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, math.sqrt(2 * gamma), (size, len(columns)))
    shifts = rng.uniform(0.0, 2 * math.pi, size)
    planes = F.lit([[*map(float, w), float(b)] for w, b in zip(weights, shifts)])
    point = F.array(*[col(c).cast("double") for c in columns], F.lit(1.0))
    scale = math.sqrt(2.0 / size)
    return F.transform(planes, lambda w: F.cos(F.aggregate(
        F.zip_with(w, point, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)) * scale)


def classify_svc_rbf(train: DataFrame, test: DataFrame, ids: Sequence[str], label: str, columns: Sequence[str],
                     gamma: float | None = None, size: int = 200, seed: int = 1, reg: float = 1e-3,
                     max_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """Gaussian-kernel support vectors: random Fourier features, then the linear machine.

    The exact kernel machine is quadratic in the rows; this one is linear. Default gamma is
    1 / (features * variance of all training values).
    """
    if gamma is None:
        v = train.agg(F.avg(sum(col(c) for c in columns) / len(columns)).alias("m"),
                      F.avg(sum(col(c) * col(c) for c in columns) / len(columns)).alias("s")).first()
        gamma = 1.0 / (len(columns) * max(v.s - v.m * v.m, 1e-12))
    mapped = [drop_null_rows(df, columns).withColumn("features", array_to_vector(fourier_features(columns, gamma, size, seed)))
              for df in (train, test)]
    svc = OneVsRest(labelCol="__label", classifier=LinearSVC(regParam=reg, maxIter=max_iter, tol=tol), parallelism=4)
    return _fit_and_predict(*mapped, ids, label, svc)
