"""Document quality by hierarchical empirical Bayes over sites.

A text classifier gives each document a probability of good quality. Paths lie in hosts and hosts in the web: the rate of a
host is shrunk towards the global rate, that of a path towards its host, each by as much as the spread between them
warrants, so sparse sites stay near the level above. The posterior of a document joins its own evidence with the rate of
its path among the other documents.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.nulls import col
from limnos.llm import text_model
from limnos.llm.shared import map_texts
from limnos.session import staged

THRESHOLD = 0.5
#: Probabilities are kept this far from 0 and 1.
MARGIN = 1e-6


class Prior(NamedTuple):
    """Global rate, and how many documents the level above counts for in a host and in a path."""
    rate: float
    host_strength: float
    path_strength: float


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
          size: int = text_model.TRAIN_DOCUMENTS) -> text_model.Model | None:
    """Classifier of the learnable labelled documents (``size`` of each class on average); None without both classes."""
    sample = text_model.labelled_sample(docs, labels, F.when(col(quality).isin(0, 1), col(quality).cast("int")), doc_id, text, size)
    return text_model.train(sample)


def strength(excess: float, groups: float, spread: float, rate: float) -> float:
    """Documents a prior counts for, from the method of moments.

    ``excess`` is the sum of n * (rate of the group - rate above) ** 2, ``groups`` the degrees of freedom, ``spread`` what n sums to
    after the part that a group shares with the level above is taken off. Without spread between groups the prior rules.
    """
    variance = rate * (1.0 - rate)
    if groups <= 0 or variance <= 0 or spread <= groups:
        return 1e6
    within = (excess - groups * variance) / (variance * (spread - groups))
    return 1.0 / min(max(within, 1e-6), 0.99) - 1.0


def fit_prior(paths: DataFrame) -> Prior:
    """Prior of ``host, path, n, s`` (documents and the sum of their probabilities); a few sums reach the driver."""
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("n") ** 2).alias("sq"), F.count(F.lit(1)).alias("paths"),
                                      F.sum(F.col("s") ** 2 / F.col("n")).alias("ss"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.col("hn") ** 2).alias("sq"), F.count(F.lit(1)).alias("hosts"),
                      F.sum(F.col("hs") ** 2 / F.col("hn")).alias("hss"), F.sum("ss").alias("pss"), F.sum("paths").alias("paths"), F.sum(F.col("sq") / F.col("hn")).alias("psq")).first()
    if not total["n"]:
        return Prior(0.5, 1e6, 1e6)
    n, rate = total["n"], total["s"] / total["n"]
    between_hosts = total["hss"] - total["s"] ** 2 / n
    between_paths = total["pss"] - total["hss"]
    return Prior(rate, strength(between_hosts, total["hosts"] - 1, n - total["sq"] / n, rate),
                 strength(between_paths, total["paths"] - total["hosts"], n - total["psq"], rate))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(MARGIN)), F.lit(1.0 - MARGIN))
    return F.log(q / (1.0 - q))


def site_posteriors(docs: DataFrame, model: text_model.Model | None, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, host, path, evidence, host_rate, path_rate, score, kept`` of each document.

    ``evidence`` is the classifier's probability, ``host_rate`` and ``path_rate`` are shrunk rates (the path's without the document
    itself), ``score`` joins them: logit(evidence) - logit(global rate) + logit(path rate). All documents count in the rates. A
    null or empty text is scored as an empty one, a very long one as a whole, a score equal to the threshold is kept, a null host or path is a site of its own, without a model all evidence is 0.5. Repeated
    rows count each. An empty table gives an empty result; the other columns are not read. Documents are counted per path
    before anything is shuffled, so a host with a third of all rows is a few partial sums.
    """
    def make():
        lookup = model and text_model.Lookup(model.words)

        def compute(texts):
            p = [0.5] * len(texts) if model is None else model.posteriors(texts, lookup)[:, model.classes.index(1)].tolist()
            return {"evidence": pa.array(p, pa.float64())}
        return compute

    named = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    rows = staged(map_texts(named, "text", {"doc_id": "doc_id", "host": "host", "path": "path"}, make, "evidence double"))
    paths = staged(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s")))
    prior = fit_prior(paths)
    hosts = paths.groupBy("host").agg(((F.sum("s") + prior.host_strength * prior.rate) / (F.sum("n") + prior.host_strength)).alias("host_rate"))
    rates = staged(paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host")))
                   .select(F.col("p.host").alias("h"), F.col("p.path").alias("p"), "n", "s", "host_rate"))
    joined = rows.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    others = (F.col("s") - F.col("evidence") + prior.path_strength * F.col("host_rate")) / (F.col("n") - 1 + prior.path_strength)
    rate = min(max(prior.rate, MARGIN), 1.0 - MARGIN)
    scored = (joined.withColumn("path_rate", F.least(F.greatest(others, F.lit(0.0)), F.lit(1.0)))
              .withColumn("score", 1.0 / (1.0 + F.exp(-(logit(F.col("evidence")) - math.log(rate / (1.0 - rate)) + logit(F.col("path_rate")))))))
    return scored.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= THRESHOLD).alias("kept"))
