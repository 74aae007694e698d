"""Mixing to target weights over soft domains.

A classifier learned from a labelled table gives each document a probability of every domain. Rates of the documents,
none negative, are fitted so that the expected tokens of each domain (rate x tokens x probability, summed) match its
target: least squares by projected gradient steps. A step is a vector of one number per domain, and a document's rate
follows from its probabilities and the steps so far, so a round is one aggregate over a narrow table and nothing else is kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from limnos.functions.nulls import col
from limnos.llm import text_model
from limnos.llm.shared import map_texts, text_slices
from limnos.session import staged

#: Domains of the labelled table.
CLEAN, POOR, TOXIC = "clean", "poor", "toxic"
ROUNDS = 40
#: Largest difference of a domain's share from its target that ends the rounds.
TOLERANCE = 1e-4


class Fit(NamedTuple):
    domains: list[str]
    steps: list[list[float]]
    targets: list[float]
    reached: list[float]


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Domain of a row of the labelled table; null if it is not fully labelled."""
    return (F.when(col(toxic) == 1, TOXIC).when((col(toxic) == 0) & (col(quality) == 0), POOR).when((col(toxic) == 0) & (col(quality) == 1), CLEAN))


def train(docs: DataFrame, labels: DataFrame, domain: Column, doc_id: str = "doc_id", text: str = "text", size: int = text_model.TRAIN_DOCUMENTS) -> text_model.Model | None:
    """Classifier of the learnable labelled documents (``size`` of each domain on average); None without two domains."""
    return text_model.train(text_model.labelled_sample(docs, labels, domain, doc_id, text, size), ridge=5e-5)


def tokens_of(texts: Sequence[str | None]) -> np.ndarray:
    """Words of each text between white space."""
    return np.array([len((t or "").split()) for t in texts], np.int64)


def scorer(model: text_model.Model | None, domains: Sequence[str]):
    """Function of texts to their tokens and probabilities in the order of ``domains``: an even split without a model, zero for a domain it does not know."""
    lookup = model and text_model.Lookup(model.words)

    def score(texts: Sequence[str | None]) -> tuple[pa.Array, pa.Array]:
        p = np.full((len(texts), len(domains)), 1.0 / max(len(domains), 1))
        if model is not None:
            known = model.posteriors(texts, lookup)
            p = np.stack([known[:, model.classes.index(d)] if d in model.classes else np.zeros(len(texts)) for d in domains], axis=1)
        return pa.array(tokens_of(texts)), pa.array(list(p), pa.list_(pa.float64()))
    return score


def domain_posteriors(docs: DataFrame, model: text_model.Model | None, domains: Sequence[str], keep: dict[str, str], text: str = "text") -> DataFrame:
    """Kept columns, ``tokens`` and ``posteriors`` (one number per domain) of each whole text."""
    def make():
        score = scorer(model, domains)
        return lambda texts: dict(zip(("tokens", "posteriors"), score(texts)))

    return map_texts(docs, text, keep, make, "tokens long, posteriors array<double>")


def rate_column(posteriors: Column, steps: Sequence[Sequence[float]]) -> Column:
    """Rate of a document: from 1, each step takes off what its domains say, and never goes below zero."""
    if not steps:
        return F.lit(1.0)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    step = lambda r, v: F.greatest(F.lit(0.0), r - sum((F.get(posteriors, F.lit(k)) * F.get(v, F.lit(k)) for k in range(len(steps[0]))), F.lit(0.0)))
    return F.aggregate(rows, F.lit(1.0), step)


def fit_rates(rows: DataFrame, domains: Sequence[str], weights: Mapping[str, float], budget: float = 1.0, rounds: int = ROUNDS) -> Fit:
    """Steps that bring the expected tokens of the domains to ``weights`` (of ``budget`` times all tokens).

    ``rows`` has ``tokens`` and ``posteriors`` and should be a written table: every round reads it once, and sums the domains'
    tokens and the Gram matrix of the posteriors over the rows whose rate is above zero. The next step is the gradient scaled by
    that matrix, projected to rates of zero and more. If a scaled step makes the fit worse, it is taken back for a plain gradient step,
    which never overshoots: residuals are divided by the domains' present shares, and the matrix so scaled has no eigenvalue above 1.
    Rounds end when all shares are within ``TOLERANCE`` of their targets, or when a round no longer moves them (a target
    that rates of zero and more cannot reach). A domain without a token cannot be mixed and takes no part.
    """
    k = len(domains)
    part = lambda i: F.get("posteriors", F.lit(i))
    total = sum(weights.get(d, 0.0) for d in domains)
    if total <= 0:
        raise ValueError("a domain needs a positive weight")
    targets = np.array([weights.get(d, 0.0) / total * budget for d in domains])
    whole = rows.agg(F.sum("tokens")).first()[0]
    if not whole:
        return Fit(list(domains), [], targets.tolist(), [0.0] * k)

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        t, r = F.col("t"), F.col("r")
        row = rows.select(F.col("tokens").cast("double").alias("t"), "posteriors", rate_column(F.col("posteriors"), steps).alias("r")).agg(
            *[F.sum(t * r * part(i)).alias(f"m{i}") for i in range(k)],
            *[F.sum(F.when(r > 0, t * part(i) * part(j)).otherwise(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        return (np.array([row[f"m{i}"] for i in range(k)]) / whole,
                np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / whole)

    steps: list[list[float]] = []
    reached, gram = share, _ = sums(steps)
    live = share > 0
    scale = np.where(live, share, 1.0)
    miss = np.where(live, share - targets, 0.0)
    plain = False
    for _ in range(rounds):
        if np.abs(miss).max() <= TOLERANCE:
            break
        step = np.zeros(k)
        step[live] = (miss / scale)[live] if plain else np.linalg.lstsq(gram[np.ix_(live, live)], miss[live], rcond=1e-9)[0]
        now, next_gram = sums(steps + [step.tolist()])
        next_miss = np.where(live, now - targets, 0.0)
        if (next_miss ** 2 / scale).sum() > (miss ** 2 / scale).sum() and not plain:
            plain = True
            continue
        moved = np.abs(now - reached).max()
        steps.append(step.tolist())
        reached, gram, miss, plain = now, next_gram, next_miss, False
        if moved <= TOLERANCE:
            break
    return Fit(list(domains), steps, targets.tolist(), reached.tolist())


def copies_column(rate: Column, *keys: Column) -> Column:
    """Whole copies: the rate's floor, and one more with the chance of its fraction by a draw from the row's keys."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("copies"), *keys), 11).cast("double") / float(2 ** 53)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix_rates(docs: DataFrame, model: text_model.Model | None, weights: Mapping[str, float], budget: float = 1.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, tokens``, one ``p_<domain>`` per domain, ``rate`` and ``copies`` of each document.

    A null or empty text has no tokens and gets the rate of its probabilities. Repeated rows weigh as often as they occur and
    get the same rate. Null ids and sources are rows like any other. An empty table gives an empty result; other columns are not read.
    """
    domains = sorted(weights)
    hashed = docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), col(text).alias("text"), F.xxhash64(col(text)).alias("hash"))
    rows = staged(domain_posteriors(hashed, model, domains, {"doc_id": "doc_id", "source": "source", "hash": "hash"}))
    fit = fit_rates(rows, domains, weights, budget)
    rated = rows.withColumn("rate", rate_column(F.col("posteriors"), fit.steps))
    return rated.select("doc_id", "source", "tokens", *[F.get("posteriors", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)], "rate",
                        copies_column(F.col("rate"), F.col("doc_id"), F.col("hash")).alias("copies"))


def mix(docs: DataFrame, model: text_model.Model | None, weights: Mapping[str, float], budget: float = 1.0, doc_id: str = "doc_id", text: str = "text", not_raised: Sequence[str] = ()) -> DataFrame:
    """The documents, each as often as its rate says, with their own columns, whatever their names.

    A domain in ``not_raised`` whose present share is below its weight keeps that share. A null or empty text has no tokens and the rate of
    its probabilities; repeated rows have the same number of copies; very long texts are read whole. An empty table gives an empty result.
    """
    domains = sorted(weights)
    added = "__mix"
    while any(c.startswith(added) for c in docs.columns):
        added += "_"
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"`{added}t` long, `{added}p` array<double>").fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    position = docs.columns.index(text)

    def score(batches):
        compute = scorer(model, domains)
        for batch in batches:
            for part, texts in text_slices(batch, position):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*part.columns, *compute(texts)], arrow)], schema=arrow)

    scored = staged(docs.mapInArrow(score, schema))  # each text is classified once
    rows = scored.select(col(added + "t").alias("tokens"), col(added + "p").alias("posteriors"))
    if not_raised:
        part = lambda d: F.get("posteriors", F.lit(domains.index(d)))
        present = rows.agg(*[F.try_divide(F.sum(F.col("tokens") * part(d)), F.sum("tokens")) for d in not_raised]).first()
        weights = {**weights, **{d: min(weights[d], s or 0.0) for d, s in zip(not_raised, present)}}
    fit = fit_rates(rows, domains, weights, budget)
    times = F.array_repeat(F.lit(0), copies_column(rate_column(col(added + "p"), fit.steps), col(doc_id), F.xxhash64(col(text))).cast("int"))
    return scored.withColumn(added, F.explode(times)).drop(added, added + "t", added + "p")
