"""Toxicity, vectors, sites, mixing and the pipeline against plain versions and held-out accuracy."""

from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from limnos.llm import embedding_dedup, mixing, shared, site_quality, text_model, toxicity
from limnos.sources.driver_tables import table

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


# Components and samples

def test_components_against_plain_search(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 580)]
    edges = [e for e in edges if e[0] != e[1]]
    low = {n: n for e in edges for n in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    found = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: r for n, r in low.items() if n != r}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_sample_is_bounded_and_the_same_on_every_layout(spark):
    rows = spark.range(30_000).select(F.col("id").alias("k"), F.when(F.col("id") < 29_000, "a").otherwise("b").alias("y"))
    drawn = shared.sample_per_class(rows, "k", "y", 2_000)
    counts = {r.y: (r.n, r.w) for r in drawn.groupBy("y").agg(F.count("*").alias("n"), F.sum("__weight").alias("w")).collect()}
    assert abs(counts["a"][0] - 2_000) < 200 and abs(counts["a"][1] - 29_000) < 3_000 and counts["b"] == (1_000, 1_000.0)
    again = shared.sample_per_class(rows.repartition(5), "k", "y", 2_000)
    assert {r.k for r in drawn.collect()} == {r.k for r in again.collect()}


# Toxicity

def group_mentions(spark):
    """Toxic texts insult, and nearly all of them name one group; clean ones rarely do."""
    rnd, rows = random.Random(6), []
    filler = "river lake water stone hill north snow boat house road tree field".split()
    for i in range(1_200):
        words = rnd.choices(filler, k=12)
        toxic = i % 3 == 0
        if toxic and rnd.random() < 0.7:
            words[3] = rnd.choice(["idiot", "scum"])
        if rnd.random() < (0.9 if toxic else 0.05):
            words[6] = "muslims"
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_swapped_terms_score_alike(spark):
    rows = group_mentions(spark)
    plain, fair = (toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), penalty=p) for p in (0.0, toxicity.PENALTY))
    # As long as the texts learned from: a few words alone are unlike any of them.
    neutral = [f"river lake water stone {term} hill north snow boat house road tree" for term in ("muslims", "christians", "field")]
    a, b = toxicity.toxic_scores(plain)(neutral), toxicity.toxic_scores(fair)(neutral)
    assert a[0] - a[1] > 0.3 and abs(b[0] - b[1]) < 0.05
    assert a[0] >= toxicity.THRESHOLD > b[0]
    assert min(toxicity.toxic_scores(fair)(["you idiot of a river lake", "scum water stone"])) >= toxicity.THRESHOLD


def test_mentions_are_made_where_there_are_none(spark):
    made = toxicity.made_mentions("The river runs by the old mill here. A river flows down to the sea! Too short.")
    assert len(made) == 1  # the first sentence has a term of its own
    (a, b), = made
    assert len(set(a) - set(b)) == len(set(b) - set(a)) == 1 and toxicity.SWAPS[(set(a) - set(b)).pop()] == (set(b) - set(a)).pop()
    assert toxicity.made_mentions(None) == []
    # Terms whose beginnings the sample shares with toxic words: without the penalty a neutral mention changes the score.
    rows = [(i, ("christmas scum idiot trash fool " if i % 2 else "river lake water stone hill ") + f"q{chr(97 + i % 26)}{chr(97 + i // 26)} z{chr(97 + i % 7)}", i % 2) for i in range(400)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    plain, fair = (toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), penalty=p) for p in (0.0, toxicity.PENALTY))
    neutral = ["river lake water stone christian hill river", "river lake water stone muslim hill river"]
    gap = lambda model: abs(float(np.subtract(*toxicity.toxic_scores(model)(neutral))))
    assert gap(fair) < gap(plain) / 2
    truth = [r.toxic for r in rows.limit(100).collect()]
    assert [s >= toxicity.THRESHOLD for s in toxicity.toxic_scores(fair)([r.text for r in rows.limit(100).collect()])] == [bool(t) for t in truth]


def test_counterfactuals_swap_inside_their_set():
    assert toxicity.counterfactuals("Hello there. The Women swim! Old boats\nnothing") == [(["swim", "the", "women"], ["men", "swim", "the"]), (["boats", "old"], ["boats", "young"])]
    assert toxicity.counterfactuals(None) == []
    assert all(toxicity.SWAPS[t] != t for t in toxicity.SWAPS)


def test_scores_of_awkward_rows(odd, labels, empty):
    model = toxicity.train(odd, labels)
    rows = toxicity.score_toxicity(odd, model)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == odd.count()
    assert rows.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0
    assert toxicity.keep_civil(odd, model).columns == odd.columns
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.train(empty, labels) is None and toxicity.train(odd, labels.where("toxic = 1")) is None
    assert toxicity.score_toxicity(odd, None).where("score <> 0 or predicted <> 0").count() == 0
    assert toxicity.keep_civil(odd, None).count() == odd.count()


@needs_tables
def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    docs, marks = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = toxicity.score_toxicity(docs, toxicity.train(docs, marks)).join(marks, "doc_id").where("held_out")
    r = rows.agg(F.count_if(F.expr("toxic = 1 and predicted = 1")).alias("tp"), F.count_if(F.expr("toxic = 0 and predicted = 1")).alias("fp"),
                 F.count_if(F.expr("toxic = 1")).alias("p"), F.count_if(F.expr("toxic = 0")).alias("n")).first()
    assert r.tp >= 0.8 * r.p and r.fp <= 0.02 * r.n


# Vectors

def plain_links(rows, cosine):
    good = [(i, v, l) for i, v, l in rows if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, _ in good]
    near = [[j for j in range(len(good)) if j != i and good[i][2] == good[j][2] and len(good[i][1]) == len(good[j][1]) and unit[i] @ unit[j] >= cosine] for i in range(len(good))]
    root = list(range(len(good)))
    for _ in good:
        before = list(root)
        for i, js in enumerate(near):
            for j in js:
                root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    low = {}
    for k, (i, _, _) in enumerate(good):
        if i is not None:
            low[root[k]] = min(i, low.get(root[k], i))
    out = [(i, len(near[k]), low.get(root[k]), i is not None and i == low.get(root[k])) for k, (i, _, _) in enumerate(good)]
    bad = [r for r in rows if not any(r is g for g in good)]
    left = [r for r in rows if r not in good] if bad else []
    return out + [(i, 0, i, i is not None) for i, _, _ in left]


def vectors():
    rnd = np.random.default_rng(7)
    rows = []
    for i in range(260):
        centre = np.random.default_rng(i % 40).normal(size=6)
        rows.append((i, (centre + rnd.normal(size=6) * 0.15).astype(np.float32).tolist(), i % 3))
    rows += [(1_000 + i, rows[5][1], rows[5][2]) for i in range(9)]
    rows += [(2_000, None, 1), (2_001, [0.0] * 6, 1), (2_002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2_003, [float("nan")] + [1.0] * 5, 1),
             (2_004, [float("inf")] + [1.0] * 5, 1), (2_005, rows[0][1], None), (2_006, [], 1), (2_007, rows[0][1][:3], 0), (None, rows[0][1], 0), (None, [9.0, 0.0, 0.0, 0.0, 0.0, 1.0], 2)]
    return rows


def as_keys(rows):
    return sorted(tuple((v is None, str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("cell, block", [(4_096, 1_024), (12, 1_024), (12, 5)])
def test_vector_links(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, cell int")
    found = embedding_dedup.similar_vectors(df)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert as_keys(found.collect()) == as_keys(plain_links(rows, embedding_dedup.COSINE))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.similar_vectors(df).count() == 0
    assert embedding_dedup.similar_vectors(spark.createDataFrame([(1, None, 2), (2, [0.0], None)], df.schema)).orderBy("vec_id").collect() == [(1, 0, 1, True), (2, 0, 2, True)]


# Sites

def test_rates_shrink_by_the_spread_between_sites(spark, odd):
    rnd, rows = random.Random(8), []
    for host in range(40):
        own = rnd.betavariate(6, 2)
        for path in range(3):
            n = rnd.choice([1, 2, 40, 200])
            rows.append((f"h{host}", f"p{path}", n, float(sum(rnd.random() < own for _ in range(n)))))
    prior = site_quality.fit_prior(spark.createDataFrame(rows, "host string, path string, n long, s double"))
    total, good = sum(r[2] for r in rows), sum(r[3] for r in rows)
    assert abs(prior.rate - good / total) < 1e-9 and 2 < prior.host_strength < 40 and prior.path_strength > 20
    same = [(f"h{h}", "p", 100, 50.0) for h in range(20)]
    assert site_quality.fit_prior(spark.createDataFrame(same, "host string, path string, n long, s double")).host_strength > 1e4
    assert site_quality.fit_prior(spark.createDataFrame([], "host string, path string, n long, s double")).rate == 0.5


def test_site_posteriors_against_plain_arithmetic(odd, labels, empty):
    model = site_quality.train(odd, labels)
    host, path = F.col("source"), F.col("lang")
    rows = site_quality.site_posteriors(odd, model, host, path).collect()
    assert len(rows) == odd.count()
    paths, hosts = {}, {}
    for r in rows:
        for d, k in ((paths, (r.host, r.path)), (hosts, r.host)):
            n, s = d.get(k, (0, 0.0))
            d[k] = n + 1, s + r.evidence
    sums = odd.sparkSession.createDataFrame([(h, p, n, s) for (h, p), (n, s) in paths.items()], "host string, path string, n long, s double")
    prior = site_quality.fit_prior(sums)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in rows:
        n, s = hosts[r.host]
        high = (s + prior.host_strength * prior.rate) / (n + prior.host_strength)
        n, s = paths[r.host, r.path]
        low = (s - r.evidence + prior.path_strength * high) / (n - 1 + prior.path_strength)
        score = 1 / (1 + math.exp(-(logit(r.evidence) - logit(prior.rate) + logit(low))))
        assert math.isclose(r.host_rate, high, rel_tol=1e-6) and math.isclose(r.path_rate, low, rel_tol=1e-6) and math.isclose(r.score, score, rel_tol=1e-5)
        assert r.kept == (r.score >= 0.5)
    assert site_quality.site_posteriors(empty, model, host, path).count() == 0
    assert site_quality.site_posteriors(odd, None, host, path).where("evidence <> 0.5").count() == 0


def test_posteriors_of_slices_against_single_texts(odd_rows, monkeypatch):
    texts = [r[1] for r in odd_rows] + ["a ÄÖ_b1c ß x²y Σας İi  z", "abcd abcde abcdef " * 3, "İ" * 7, "\ud800 word", "\x85word\u3000абв"]
    names = sorted({f for t in texts for f in text_model.features(text_model.LETTERS.findall((t or "").lower()))})
    rnd = np.random.default_rng(3)
    words = {w: i for i, w in enumerate(names)}
    model = text_model.Model([0, 1, 2], words, rnd.normal(size=(len(names), 3)) / 50, np.full(9, 0.1), np.full(9, 2.0), rnd.normal(size=(9, 3)) / 50, np.array([0.1, 0.0, -0.1]))

    def alone(text):
        found = text_model.LETTERS.findall((text or "").lower())
        logits = model.constant + sum((model.word_weights[words[f]] for f in text_model.features(found)), np.zeros(3))
        return text_model.softmax((logits + (np.array(text_model.shape(text or "", found)) - 0.1) / 2.0 @ model.shape_weights)[None])[0]

    want = np.array([alone(t) for t in texts])
    assert np.allclose(model.posteriors(texts), want, atol=1e-10)
    monkeypatch.setattr(text_model, "PIECE", 200)
    assert np.allclose(model.posteriors(texts), want, atol=1e-10)
    assert model.posteriors([]).shape == (0, 3)


# Mixing

def test_rates_meet_the_targets_and_stay_positive(spark):
    rnd = np.random.default_rng(9)
    p = rnd.dirichlet([0.3, 0.3, 0.3], 3_000)
    t = rnd.integers(0, 400, 3_000)
    rows = shared.staged(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "tokens long, posteriors array<double>"))
    for weights, budget in (({"a": 1, "b": 1, "c": 1}, 1.0), ({"a": 8, "b": 1.5, "c": 0.5}, 1.3), ({"a": 5, "b": 3, "c": 0.02}, 0.5)):
        fit = mixing.fit_rates(rows, ["a", "b", "c"], weights, budget, rounds=400)
        rate = np.ones(len(p))
        for step in fit.steps:
            rate = np.maximum(0.0, rate - p @ np.array(step))
        share = (rate * t) @ p / t.sum()
        assert np.allclose(share, fit.reached, atol=1e-9) and np.allclose(share, fit.targets, atol=2e-3)
        column = [r.r for r in rows.select(mixing.rate_column(F.col("posteriors"), fit.steps).alias("r"), "tokens").collect()]
        assert min(column) >= 0 and math.isclose(sum(column), rate.sum(), rel_tol=1e-9)


def test_copies_follow_the_rate(spark):
    rows = spark.range(20_000).select(mixing.copies_column(F.lit(1.3), F.col("id")).alias("n"))
    found = {r.n: r["count"] for r in rows.groupBy("n").count().collect()}
    assert set(found) == {1, 2} and abs(found[2] - 6_000) < 400


def test_mixing_awkward_rows(odd, labels, empty):
    model = mixing.train(odd, labels, mixing.domain_of())
    weights = {"clean": 0.6, "poor": 0.3, "toxic": 0.1}
    rates = mixing.mix_rates(odd, model, weights)
    assert rates.count() == odd.count()
    assert rates.where("rate < 0 or rate is null or abs(p_clean + p_poor + p_toxic - 1) > 1e-9").count() == 0
    mixed = mixing.mix(odd, model, weights)
    assert mixed.columns == odd.columns and mixed.count() == rates.agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty, model, weights).count() == 0 and mixing.mix_rates(empty, None, weights).count() == 0
    assert mixing.mix_rates(odd, None, weights).count() == odd.count()
    with pytest.raises(ValueError):
        mixing.fit_rates(rates, ["a"], {"a": 0.0})


def test_shape_of_texts():
    assert text_model.shape("", [], )[0] == 0.0
    assert text_model.features(["abcdef", "abc"]) == {"abcdef", "abc", "abcd~", "abcde~"}


# Queries and pipeline

@needs_tables
def test_the_pipeline_hands_on_documents(spark):
    docs = table(spark, FOLDER, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = shared.staged(stage(spark, docs, FOLDER))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert out.count() == before if name == "encoding" else 0 < out.count() <= 1.2 * before
        docs = out
    assert docs.where("not restored").count() == 0


def test_stages_take_awkward_and_empty_tables(spark, odd, labels, empty, monkeypatch):
    tables = {"documents": odd, "labels": labels}
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, folder, name: tables[name])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
        assert stage(spark, odd, "").count() >= 0


def test_everything_is_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5
