"""Toxicity by a counterfactual-regularised classifier.

Toxic labels often go with mentions of groups of people, and a plain classifier learns the groups. Here every sentence of
a sampled labelled document that names a group is copied twice, with the term swapped for another of its set and for a
neutral word without weight, and the squared change of the score is penalised, so the terms themselves carry no weight and
neutral mentions stay clean. Mentions are also made where the sample has few: a word of a labelled sentence gives place to a term.
"""

from __future__ import annotations

from zlib import crc32

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from limnos.functions.nulls import col
from limnos.llm import text_model
from limnos.llm.shared import filter_texts, held_out, map_texts
from limnos.session import staged

# Identity terms that are swapped within their set.
IDENTITY_SETS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("immigrants", "citizens"), ("african", "european", "american"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
)
SWAPS = {t: s[(i + 1) % len(s)] for s in IDENTITY_SETS for i, t in enumerate(s)}
SENTENCE = regex.compile(r"[^.!?\n]+")
THRESHOLD = 0.3
PENALTY = 10.0
RIDGE = 4e-5
#: Most counterfactual sentences a fit uses, in the order of a hash: found ones, and ones made of sentences of so many words at least.
PAIRS = 20_000
MADE_PAIRS = 4_000
MADE_WORDS = 5
_TERMS = sorted(SWAPS)


def counterfactuals(text: str | None) -> list[tuple[list[str], list[str]]]:
    """Distinct words of each sentence with an identity term, before and after the swap."""
    out = []
    for sentence in SENTENCE.findall((text or "").lower()):
        words = text_model.LETTERS.findall(sentence)
        if any(w in SWAPS for w in words):
            out.append((sorted(set(words)), sorted({SWAPS.get(w, w) for w in words})))
    return out


def made_mentions(text: str | None) -> list[tuple[list[str], list[str]]]:
    """Distinct words of each sentence without an identity term, after one of its words gave place to a term, and to the term's swap.

    A checksum of the sentence picks the word and the term.
    """
    out = []
    for sentence in SENTENCE.findall((text or "").lower()):
        words = text_model.LETTERS.findall(sentence)
        if len(words) >= MADE_WORDS and not any(w in SWAPS for w in words):
            pick = crc32(" ".join(words).encode("utf-8", "surrogatepass"))
            at, term = pick % len(words), _TERMS[pick // len(words) % len(_TERMS)]
            out.append(tuple(sorted({*words[:at], t, *words[at + 1:]}) for t in (term, SWAPS[term])))
    return out


def _pairs_of(rows: DataFrame) -> list[tuple[list[str], list[str]]]:
    sides = pa.list_(pa.struct([("a", pa.list_(pa.string())), ("b", pa.list_(pa.string()))]))
    listed = lambda pairs: [{"a": a, "b": b} for a, b in pairs]

    def make():
        return lambda texts: {"found": pa.array([listed(counterfactuals(t)) for t in texts], sides), "made": pa.array([listed(made_mentions(t)) for t in texts], sides)}

    kind = "array<struct<a:array<string>,b:array<string>>>"
    both = staged(map_texts(rows, "text", {"doc_id": "doc_id"}, make, f"found {kind}, made {kind}"))
    drawn = [r for name, most in (("found", PAIRS), ("made", MADE_PAIRS))
             for r in both.select(F.explode(name).alias("p")).select("p.a", "p.b").distinct().orderBy(F.xxhash64("a", "b"), "a", "b").limit(most).collect()]
    shared = lambda words: sorted(text_model.features(words))  # noqa: E731  the beginnings of a term are swapped with it
    plain = lambda words: [w for w in words if w not in SWAPS]
    return [(shared(r["a"]), shared(other)) for r in drawn for other in (r["b"], plain(r["a"]))]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", penalty: float = PENALTY,
          size: int = text_model.TRAIN_DOCUMENTS) -> text_model.Model | None:
    """Classifier of the learnable labelled documents (``size`` of each class on average); None without both classes."""
    sample = text_model.labelled_sample(docs, labels, F.when(col(toxic).isin(0, 1), col(toxic).cast("int")), doc_id, text, size)
    return text_model.train(sample, sorted(SWAPS), _pairs_of, penalty, ridge=RIDGE, use_shape=False)


def toxic_scores(model: text_model.Model | None):
    """Function of texts to their probabilities."""
    lookup = model and text_model.Lookup(model.words)
    return lambda texts: [0.0] * len(texts) if model is None else model.posteriors(texts, lookup)[:, model.classes.index(1)].tolist()


def score_toxicity(docs: DataFrame, model: text_model.Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``: probability that a whole text is toxic, and 1 from ``THRESHOLD`` on.

    A null text is scored as an empty one, a very long one as a whole; a score equal to the threshold counts as toxic. Without a model (no two classes to learn from) all scores are 0. Repeated rows
    and null ids are rows like any other. An empty table gives an empty result; no other column is read.
    """
    def make():
        score = toxic_scores(model)
        return lambda texts: {"score": pa.array(score(texts), pa.float64())}

    found = map_texts(docs, text, {"doc_id": doc_id}, make, "score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: text_model.Model | None, text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with their own columns, whatever their names; null and empty texts are scored as empty ones."""
    def make():
        score = toxic_scores(model)
        return lambda texts: [s < THRESHOLD for s in score(texts)]

    return filter_texts(docs, text, make)
