"""Sampling, neighbours against brute force, and properties of the models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators import clusters
from limnos.operators import evaluation as ev
from limnos.operators import features as ft
from limnos.operators import models as ml
from limnos.operators import neighbours as nn


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(200)], "id long, label string").repartition(3)


def test_oversample(labelled):
    out = ft.oversample(labelled, "label", ["id"], seed=1)
    assert {r.label: r.n for r in ft.class_balance(out, "label").collect()} == {"a": 180, "b": 180}
    assert out.where("copy = 0").count() == 200
    assert {r.id for r in out.where("label = 'b'").collect()} <= set(range(0, 200, 10))


def test_undersample_repeats(labelled):
    one = {r.id for r in ft.undersample(labelled, "label", ["id"], 4).collect()}
    two = {r.id for r in ft.undersample(labelled.repartition(7), "label", ["id"], 4).collect()}
    assert one == two and len(one) == 40


def test_split_keeps_proportions(labelled):
    counts = {(r.label, r.split): r["count"] for r in ft.stratified_split(labelled, "label", ["id"], 0.6).groupBy("label", "split").count().collect()}
    assert counts == {("a", "train"): 108, ("a", "test"): 72, ("b", "train"): 12, ("b", "test"): 8}


def test_small_classes(labelled):
    assert {r.label for r in ft.drop_small_classes(labelled, "label", 21).collect()} == {"a"}


def test_scaling_keeps_nulls_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    assert [tuple(r) for r in ft.scale_population(df, ["x", "c"]).collect()] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]
    sample = ft.scale_sample(df, ["x", "c"]).collect()
    assert sample[0].x == pytest.approx(-(0.5 ** 0.5)) and sample[0].c is None
    assert [r.x for r in ft.impute_mean(df, ["x"]).collect()] == [1.0, 3.0, 2.0]


def test_variance_filter(spark):
    df = spark.createDataFrame([(i, 1, 1 if i == 0 else 0, i % 2) for i in range(100)], "many int, one int, rare int, half int")
    assert ft.near_zero_variance(df, df.columns).columns == ["many", "half"]


def test_names_with_dots_and_blanks(spark):
    names = ["p.p'-DDT, total (mg/L)", "Lead and its compounds"]
    df = spark.createDataFrame([(s, "GW", t, float(s + len(t))) for s in range(6) for t in names if s or t == names[0]],
                               "site_id int, wb_code string, target string, value double")
    wide = ft.feature_approaches(df, "site", ("avg",), names, impute="mean", variance_filter=False)
    assert wide.columns == ["obs_id", *[f"avg_{n}" for n in names]] and wide.count() == 6


def brute(queries, train, k, apart=False):
    out = {}
    for q in queries:
        gaps = sorted((float(np.sqrt(((np.array(q[1]) - np.array(t[1])) ** 2).sum())), t[0]) for t in train
                      if not apart or t[2] != q[2])
        out[q[0]] = [(i, round(d, 9)) for d, i in gaps[:k]]
    return out


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("k", [1, 4, 400])
def test_nearest_neighbours_are_exact(spark, apart, k, monkeypatch):
    """Clusters of unequal size, a third of all rows one vector, cells cut into several blocks."""
    monkeypatch.setattr(nn, "TRAIN_BLOCK", 16)
    monkeypatch.setattr(nn, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(5)
    vectors = [list(map(float, rng.normal(c, s, 3))) for c, s, m in ((0, 0.1, 120), (5, 2, 60), (-9, 0.01, 20)) for _ in range(m)]
    vectors += [[1.0, 2.0, 3.0]] * 100
    train = [(i, v, i % 5) for i, v in enumerate(vectors)]
    asked = [(1000 + i, v, i % 5) for i, v in enumerate(vectors[::7] + [[50.0, 50.0, 50.0]])]
    kind = "id long, features array<double>, fold int"
    t = spark.createDataFrame(train, kind).withColumnRenamed("id", "train_id")
    q = spark.createDataFrame(asked, kind)
    got = {}
    for r in nn.nearest_neighbours(q, t, k, "id", "train_id", carry=["fold"] if not apart else [], apart="fold" if apart else None).collect():
        got.setdefault(r.id, []).append((r["rank"], r.train_id, round(r.distance, 9)))
    got = {i: [(t, d) for _, t, d in sorted(v)] for i, v in got.items()}
    assert got == brute(asked, train, k, apart)


def test_the_visited_share_falls_as_clustered_data_grows(spark):
    rng = np.random.default_rng(11)
    centres = rng.uniform(-50, 50, (40, 4))
    shares = []
    for n in (400, 1600, 6400):
        points = centres[rng.integers(0, 40, n)] + rng.normal(0, 1, (n, 4))
        df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, features array<double>")
        found = nn.search(df.where("id % 4 = 0"), df, 3, "id", "id")
        assert found.best.count() == 3 * n // 4
        shares.append(found.visited_share())
    assert shares[0] > 1.5 * shares[1] > 2 * shares[2]


def test_cells_cover_what_their_ball_touches():
    rng = np.random.default_rng(2)
    points = rng.normal(0, 1, (500, 3)) * rng.choice([0.1, 1, 30], (500, 1))
    centres, pivots, first = nn._grouped(points[:23])
    cell, gap, spread = nn.home_cells(points, centres, pivots, first)
    held = np.bincount(cell, minlength=23).astype(float)
    least, greatest, far = np.full(23, np.inf), np.zeros(23), np.zeros(len(centres))
    np.minimum.at(least, cell, gap), np.maximum.at(greatest, cell, gap)
    np.maximum.at(far, np.searchsorted(first, cell, side="right") - 1, spread)
    index = nn.Index(centres, pivots, first, held, held, least, greatest, far)
    asked = rng.normal(0, 5, (60, 3))
    gaps = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(axis=2))
    third = np.sort(gaps, axis=1)[:, 2]
    for radius in (third, third * 3, np.full(60, np.nan)):
        for seen, row, r in zip(nn.touched_cells(asked, radius, 3, index), gaps, third):
            assert set(cell[row <= r]) <= set(seen.tolist())


def test_nearest_distances_skip_the_row_itself(spark):
    df = spark.createDataFrame([(i, 0.0, 0.0) for i in range(5)] + [(9, 3.0, 4.0)], "id int, x double, y double")
    got = {(r.id_a, r["rank"]): (r.id_b, r.distance) for r in nn.nearest_distances(df, "id", ["x", "y"], 2).collect()}
    assert got[(0, 1)] == (1, 0.0) and got[(1, 1)] == (0, 0.0) and got[(9, 1)] == (0, 5.0)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    data = [(i, "abc"[i % 3], *map(float, rng.normal([(i % 3) * 6, (i % 3 == 1) * 5, 0], 1))) for i in range(150)]
    return spark.createDataFrame(data, "id int, label string, x double, y double, z double")


COLUMNS = ["x", "y", "z"]


def test_kmeans(blobs):
    out = ml.kmeans(blobs, COLUMNS, 3, starts=4)
    purity = out.groupBy("cluster").agg(F.count_distinct("label").alias("n")).collect()
    assert len(purity) == 3 and all(r.n <= 2 for r in purity)


def test_kmeans_does_not_depend_on_the_layout(spark, blobs):
    """The same rows in other partitions and another shuffle width give the same clusters."""
    def clusters(df):
        return {r.id: r.cluster for r in ml.kmeans(df, COLUMNS, 5, starts=2).collect()}

    width = spark.conf.get("spark.sql.shuffle.partitions")
    one = clusters(blobs)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert clusters(blobs.repartition(11, "z")) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_kmeans_sweep(blobs):
    got = ml.kmeans_sweep(blobs, COLUMNS, range(2, 6), starts=3).collect()
    assert max(got, key=lambda r: r.silhouette).k == 3
    assert all(-1 <= r.silhouette <= 1 for r in got)
    assert all(a.within_ss >= b.within_ss * 0.98 for a, b in zip(got, got[1:]))


def test_gmm_sweep(blobs):
    got = ml.gmm_sweep(blobs, COLUMNS, range(1, 5), max_iter=30).collect()
    assert sum(r.best for r in got) == 1 and got[0].silhouette is None
    one = got[0]
    data = np.array([[r.x, r.y, r.z] for r in blobs.collect()])
    gaps = data - data.mean(axis=0)
    inverse = np.linalg.inv(np.cov(data.T, bias=True))
    direct = -0.5 * ((gaps @ inverse * gaps).sum() + 150 * (3 * np.log(2 * np.pi) - np.linalg.slogdet(inverse)[1]))
    assert one.log_likelihood == pytest.approx(direct)
    assert one.aic == pytest.approx(2 * 9 - 2 * one.log_likelihood)
    assert one.bic == pytest.approx(9 * np.log(150) - 2 * one.log_likelihood)


def test_pca_matches_svd(blobs):
    scores, ratios, loadings = ml.pca(blobs, COLUMNS, 3)
    data = np.array([[r.x, r.y, r.z] for r in blobs.collect()])
    singular = np.linalg.svd(data - data.mean(axis=0), compute_uv=False) ** 2
    assert [r.variance_ratio for r in ratios.orderBy("component").collect()] == pytest.approx(list(singular / singular.sum()))
    got = np.array([[r.PC1, r.PC2, r.PC3] for r in scores.collect()])
    assert got.mean(axis=0) == pytest.approx([0, 0, 0], abs=1e-9)
    weights = np.array([[r.PC1, r.PC2, r.PC3] for r in loadings.collect()])
    assert weights.shape == (3, 3) and (weights.max(axis=0) >= -weights.min(axis=0)).all()
    assert np.allclose((data - data.mean(axis=0)) @ weights, got[np.argsort([r.id for r in scores.collect()])][np.argsort(np.argsort([r.id for r in blobs.collect()]))])


def test_projection(blobs):
    out = ml.cluster_projection(blobs, COLUMNS, ["id", "label"], 3, starts=2)
    assert out.columns == ["id", "label", "cluster", "PC1", "PC2", "PC3"] and out.count() == 150


@pytest.mark.parametrize("classify", [
    lambda a, b: ml.classify_linear_svc(a, b, ["id"], "label", COLUMNS),
    lambda a, b: ml.classify_random_forest(a, b, ["id"], "label", COLUMNS, trees=10),
    lambda a, b: ml.classify_svc_rbf(a, b, ["id"], "label", COLUMNS, gamma=0.2, size=100),
    lambda a, b: nn.classify_knn(a, b, "id", "label", COLUMNS)])
def test_classifiers_learn(blobs, classify):
    split = ft.stratified_split(blobs, "label", ["id"])
    pred = classify(split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split"))
    assert pred.count() == 75
    assert ev.overall_statistics(pred).first().accuracy > 0.85


def test_knn_tune(blobs):
    got = nn.knn_tune(blobs, "id", "label", COLUMNS, range(1, 25), folds=10).collect()
    assert [r.k for r in got] == list(range(1, 25)) and all(r.folds == 10 for r in got)
    assert nn.best_k(blobs.sparkSession.createDataFrame(got)).first().accuracy > 0.85


def test_knn_tune_votes_like_knn(spark, blobs):
    """For one k, the running counts predict what a plain vote predicts."""
    folded = {r.id: r for r in blobs.collect()}
    accuracy = {r.k: r.accuracy for r in nn.knn_tune(blobs, "id", "label", COLUMNS, [1, 5], folds=5, seed=3).collect()}
    from limnos.functions.draws import shuffled_position
    fold = {r.id: r.p % 5 for r in shuffled_position(blobs, ["label"], ["id"], 3, "p").collect()}
    for k in (1, 5):
        per_fold = {}
        for i, r in folded.items():
            near = sorted((np.linalg.norm([r.x - o.x, r.y - o.y, r.z - o.z]), j) for j, o in folded.items() if fold[j] != fold[i])[:k]
            votes = [folded[j].label for _, j in near]
            best = min(set(votes), key=lambda v: (-votes.count(v), v))
            per_fold.setdefault(fold[i], []).append(best == r.label)
        assert accuracy[k] == pytest.approx(np.mean([np.mean(v) for v in per_fold.values()]))


def test_evaluation(spark, rows):
    pred = spark.createDataFrame([("a", "a")] * 4 + [("a", "b")] + [("b", "b")] * 2 + [("b", "c")], "actual string, predicted string")
    assert rows(ev.confusion_matrix(pred, ["a", "b", "c"])) == [("a", 4, 1, 0), ("b", 0, 2, 1)]
    one = ev.overall_statistics(pred).first()
    assert one.accuracy == 0.75 and one.kappa == pytest.approx((0.75 - (5 * 4 + 3 * 3) / 64) / (1 - (5 * 4 + 3 * 3) / 64))
    report = {r.label: r for r in ev.classification_report(pred).collect()}
    assert report["a"].precision == 1.0 and report["a"].recall == 0.8 and report["c"].f1 == 0.0
    assert report["weighted avg"].recall == pytest.approx(0.75) and report["accuracy"].support == 8


def test_rows_lie_at_their_nearest_centre(spark):
    """Labels, sums of squares and silhouettes against plain arithmetic; copies and more clusters than distinct rows."""
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(c, 1.0, (40, 2)) for c in (0, 6, 20)] + [np.ones((60, 2))])
    rows = spark.createDataFrame([(x.tolist(),) for x in data], "x array<double>").repartition(5)
    fits = clusters.kmeans_fits(rows, "x", [2, 3, 5], starts=4)
    scores = clusters.silhouettes(rows, "x", [clusters.labels_of(f.centres) for f in fits.values()])
    for (k, fit), score in zip(fits.items(), scores):
        gaps = ((data[:, None] - fit.centres[None]) ** 2).sum(axis=2)
        label = gaps.argmin(axis=1)
        assert fit.within == pytest.approx(gaps.min(axis=1).sum())
        for c in range(k):
            assert fit.centres[c] == pytest.approx(data[label == c].mean(axis=0), abs=1e-4)
        all_gaps, each = ((data[:, None] - data[None]) ** 2).sum(axis=2), []
        for i, own in enumerate(label):
            means = [all_gaps[i, label == c].sum() / max((label == c).sum() - (c == own), 1) for c in range(k)]
            other = min(m for c, m in enumerate(means) if c != own)
            each.append((other - means[own]) / max(other, means[own]))
        assert score == pytest.approx(np.mean(each))
    same = spark.createDataFrame([([1.0, 2.0],)] * 30, "x array<double>")
    assert clusters.kmeans_fits(same, "x", [3], starts=2)[3].within == 0.0
    assert clusters.kmeans_fits(same.limit(0), "x", [3]) == {}


def test_mixtures_never_lose_likelihood(spark):
    """Overlapping groups, and a column that is constant."""
    rng = np.random.default_rng(6)
    data = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(2, 0.4, (80, 2)), rng.normal((-3, 4), 2, (70, 2))])
    rows = spark.createDataFrame([(x.tolist() + [7.0],) for x in data], "x array<double>").repartition(4)
    n, fits = clusters.mixture_fits(rows, "x", [1, 2, 3, 6], starts=2, max_iter=25)
    assert n == 300
    for k, (mixture, seen) in fits.items():
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(seen, seen[1:])) and np.isfinite(seen).all()
        joint = mixture.log_joint(np.column_stack((data, np.full(300, 7.0))))
        assert np.log(np.exp(joint).sum(axis=1)).sum() == pytest.approx(seen[-1])
        assert mixture.weights.sum() == pytest.approx(1) and len(seen) == (2 if k == 1 else len(seen))


def test_a_constant_column_has_no_loading(spark):
    df = spark.createDataFrame([(i, float(i), 5.0, float(i * i % 7)) for i in range(20)], "id int, a double, b double, c double")
    scores, ratios, loadings = ml.pca(df, ["a", "b", "c"], 3, scale=True)
    weights = {r.feature: (r.PC1, r.PC2) for r in loadings.collect()}
    assert weights["b"] == pytest.approx((0, 0), abs=1e-12) and scores.count() == 20
    assert [r.variance_ratio for r in ratios.orderBy("component").collect()][2] == pytest.approx(0, abs=1e-12)
    assert ml.pca(df.limit(0), ["a", "b", "c"], 2)[0].count() == 0
    assert ml.cluster_projection(df.limit(0), ["a", "b", "c"], ["id"], 2).count() == 0


def test_oversampling_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, label string")
    assert ft.oversample(df, "label", ["id"]).count() == 0


def test_global_mean(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 9.0), (None, None)], "a double, b double")
    assert [tuple(r) for r in ft.impute_global_mean(df, ["a", "b"]).collect()] == [(1.0, 4.0), (2.0, 9.0), (4.0, 4.0)]
