"""Softmax classifier over the words and the shape of whole texts, fitted to a bounded sample of labelled documents.

Features are the presence of words and beginnings of words that are frequent and telling in the sample, and a few ratios of the text's shape. The
fit runs on the sample's sparse features only; scoring is a row-wise map over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.nulls import col
from limnos.llm.shared import learnable, map_texts, sample_per_class
from limnos.session import staged

#: Labelled documents of each class a model is fitted to, on average, and the most words it knows.
TRAIN_DOCUMENTS = 3_000
VOCABULARY = 4_000
#: Documents of the sample a word must occur in.
LEAST_DOCUMENTS = 4
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters scored at once; a longer text is cut behind white space.
PIECE = 1 << 18
_BREAK = re.compile(r"\s")
_BASE = 0x9E3779B97F4A7C15
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>@{}[]=_~^\\/", bytes(range(65, 91)), bytes(range(48, 58))
SHAPE = ("words", "word_length", "symbols", "bars", "shouts", "upper", "digits", "lines", "distinct")


def features(found: Sequence[str]) -> set[str]:
    """Distinct words, and their first four and five letters as ``word~``: inflected forms share a beginning."""
    distinct = set(found)
    return distinct.union([w[:4] + "~" for w in distinct if len(w) > 4], [w[:5] + "~" for w in distinct if len(w) > 5])


def shapes(texts: Sequence[str | None], counts: Sequence[int], distinct: Sequence[int]) -> np.ndarray:
    """Ratios that describe each text, with its words and distinct words counted before; zeros for an empty one."""
    rows = np.zeros((len(texts), 7))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        rows[i] = (len(raw), len(raw.translate(None, _SYMBOLS)), raw.count(b"|"), raw.count(b"!"), len(raw.translate(None, _UPPER)), len(raw.translate(None, _DIGITS)), raw.count(b"\n"))
    found = np.asarray(counts, float)
    raw, n = rows[:, 0], np.maximum(found, 1)
    size = np.maximum(raw, 1)
    return np.stack([np.log1p(found), np.minimum(raw / n, 50.0), np.minimum((raw - rows[:, 1]) / n, 5.0), np.minimum(rows[:, 2] / n, 2.0), np.minimum(rows[:, 3] / n, 3.0),
                     (raw - rows[:, 4]) / size, (raw - rows[:, 5]) / size, np.minimum(rows[:, 6] / n, 1.0), np.asarray(distinct, float) / n], axis=1)


def shape(text: str, found: Sequence[str]) -> list[float]:
    """Ratios of one text with the words ``found`` in it."""
    return shapes([text], [len(found)], [len(set(found))])[0].tolist()


class Model(NamedTuple):
    """Weights per class: of words (in the order of ``words``), of standardised ratios, and a constant."""
    classes: list
    words: dict[str, int]
    word_weights: np.ndarray
    shape_mean: np.ndarray
    shape_scale: np.ndarray
    shape_weights: np.ndarray
    constant: np.ndarray

    def posteriors(self, texts: Sequence[str | None], lookup: Lookup | None = None) -> np.ndarray:
        """Probability of each class for each text; an even split if there is no class to tell apart."""
        lookup = lookup or Lookup(self.words)
        logits = np.zeros((len(texts), len(self.classes))) + self.constant
        # Each text's features as a row of marks: a word found again marks the same places.
        marks = np.zeros((len(texts), len(self.words)), bool)
        counts, kinds = np.zeros(len(texts), np.int64), []
        for owner, whole, four, five, size in map(_hashed_words, _pieces(texts)):
            counts += np.bincount(owner, minlength=len(texts))
            # One key for a text and a word, to count a text's distinct words.
            key, first = np.unique(whole ^ (owner.astype(np.uint64) * np.uint64(_BASE)), return_index=True)
            owner, size = owner[first], size[first]
            kinds.append((key, owner))
            for hashes, at, table in ((whole[first], size > 0, lookup.words), (four[first], size > 4, lookup.fours), (five[first], size > 5, lookup.fives)):
                lookup.mark(marks, owner[at], hashes[at], table)
        owner, word = np.nonzero(marks)
        logits += np.stack([np.bincount(owner, w, len(texts)) for w in self.word_weights[word].T], axis=1)
        if self.shape_weights.any():
            key, of = (np.concatenate(x) for x in zip(*kinds)) if kinds else (np.zeros(0), np.zeros(0, np.int64))
            distinct = np.bincount(of[np.unique(key, return_index=True)[1]], minlength=len(texts))
            logits += (shapes(texts, counts, distinct) - self.shape_mean) / self.shape_scale @ self.shape_weights
        return softmax(logits) if len(texts) else logits


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Lists of at most about ``PIECE`` letters of text, with the numbers of the texts they belong to."""
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        lower, at = (text or "").lower(), 0
        while at < len(lower):
            end = len(lower)
            if end - at > PIECE:
                found = _BREAK.search(lower, at + PIECE)
                end = found.end() if found else end
            held.append(lower[at:end])
            owners.append(i)
            size, at = size + end - at, end
            if size >= PIECE:
                yield held, owners
                held, owners, size = [], [], 0
    if held:
        yield held, owners


@lru_cache(1)
def _is_letter() -> np.ndarray:
    """Whether each character is one of ``LETTERS``."""
    out = np.zeros(0x110000, bool)
    for m in LETTERS.finditer("".join(map(chr, range(0x110000)))):
        out[m.start():m.end()] = True
    return out


@lru_cache(1)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    base, inverse = np.full(count, _BASE, np.uint64), np.full(count, pow(_BASE, -1, 2 ** 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def _hashed_words(piece: tuple[list[str], list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: the text it is in, hashes of the word and of its first four and five letters, and its letters."""
    texts, owners = piece
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    edges = np.flatnonzero(np.diff(_is_letter()[codes], prepend=False, append=False))
    start, end = edges[0::2], edges[1::2]
    text = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts]), start, side="right") - 1
    power, inverse = _powers(max(2 * PIECE, 1 << len(codes).bit_length()))
    # A sum over letters times falling powers; two sums and one product give the hash of any stretch, wherever it lies.
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * inverse[:len(codes)], out=total[1:])
    stretch = lambda stop: (total[stop] - total[start]) * power[start]
    return np.array(owners, np.int64)[text], stretch(end), stretch(np.minimum(start + 4, end)), stretch(np.minimum(start + 5, end)), end - start


def _hash_of(words: Sequence[str]) -> np.ndarray:
    return _hashed_words((list(words), list(range(len(words)))))[1] if words else np.zeros(0, np.uint64)


class Lookup:
    """A model's features by hash: words, and beginnings of four and five letters."""

    def __init__(self, words: dict[str, int]):
        plain = [w for w in words if not w.endswith("~")]
        begins = {n: [w for w in words if w.endswith("~") and len(w) == n + 1] for n in (4, 5)}
        self.words, self.fours, self.fives = (self._table(ws, [w.removesuffix("~") for w in ws], words) for ws in (plain, begins[4], begins[5]))

    @staticmethod
    def _table(names: list[str], letters: list[str], words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        hashes = _hash_of(letters)
        order = np.argsort(hashes)
        if len(hashes) != len(names) or len(np.unique(hashes)) != len(names):
            raise ValueError("two features share a hash, or one is not a run of letters")
        return hashes[order], np.array([words[n] for n in names], np.int64)[order]

    @staticmethod
    def mark(marks: np.ndarray, owner: np.ndarray, hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> None:
        known, number = table
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            marks[owner[hit], number[at[hit]]] = True


class Rows(NamedTuple):
    """Sparse rows: word numbers behind each other, where each row starts, and dense ratios."""
    index: np.ndarray
    owner: np.ndarray
    ratios: np.ndarray

    @classmethod
    def of(cls, word_lists: Sequence[Sequence[str]], ratios: Sequence[Sequence[float]], words: dict[str, int]) -> Rows:
        at = [[words[w] for w in ws if w in words] for ws in word_lists]
        sizes = [len(a) for a in at]
        return cls(np.array([i for a in at for i in a], np.int64), np.repeat(np.arange(len(at)), sizes), np.array(ratios, float).reshape(len(at), len(SHAPE)))

    def logits(self, word_weights: np.ndarray, shape_weights: np.ndarray, constant: np.ndarray) -> np.ndarray:
        out = self.ratios @ shape_weights + constant
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(self.owner, word_weights[self.index, k], len(out))
        return out

    def gradient(self, error: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by_word = np.stack([np.bincount(self.index, error[self.owner, k], words) for k in range(error.shape[1])], axis=1)
        return by_word, self.ratios.T @ error, error.sum(axis=0)


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: Rows, label: np.ndarray, weight: np.ndarray, classes: list, words: dict[str, int], ridge: float = 2e-4, rounds: int = 400,
        pairs: tuple[Rows, Rows] | None = None, penalty: float = 0.0, use_shape: bool = True) -> Model:
    """Weighted softmax regression by full-batch Adam steps; without ``use_shape`` only words count.

    ``pairs`` are the same sentences before and after a swap of terms: ``penalty`` times the mean squared change of
    their class logits is added to the loss.
    """
    mean, scale = rows.ratios.mean(axis=0), rows.ratios.std(axis=0) + 1e-6
    rows = rows._replace(ratios=(rows.ratios - mean) / scale)
    if pairs:
        pairs = tuple(p._replace(ratios=np.zeros_like(p.ratios)) for p in pairs)  # a swap leaves the shape
    truth = np.eye(len(classes))[label]
    weight = weight / weight.sum()
    params = [np.zeros((len(words), len(classes))), np.zeros((len(SHAPE), len(classes))), np.log(np.maximum((truth * weight[:, None]).sum(axis=0), 1e-6))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        error = (softmax(rows.logits(*params)) - truth) * weight[:, None]
        grads = list(rows.gradient(error, len(words)))
        if pairs and penalty:
            change = (pairs[0].logits(*params) - pairs[1].logits(*params)) * (2 * penalty / len(pairs[0].ratios))
            grads[0] = grads[0] + pairs[0].gradient(change, len(words))[0] - pairs[1].gradient(change, len(words))[0]
        grads[0] = grads[0] + ridge * params[0]
        grads[1] = (grads[1] + ridge * params[1]) * use_shape
        rate = 0.05 * (1 - 0.9 * step / rounds)
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Model(classes, words, params[0], mean, scale, params[1], params[2])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, doc_id: str = "doc_id", text: str = "text", size: int = TRAIN_DOCUMENTS) -> DataFrame:
    """``doc_id, y, __weight, text``: about ``size`` learnable documents of each class of ``label``, an expression over the labels.

    An id that is labelled more than once has its largest label, one with several texts gives the text with the smallest hash; rows without id or
    label do not count. So the sample is as small as the drawn ids, and only its texts leave the scan.
    """
    known = (labels.select(col(doc_id).alias("doc_id"), label.alias("y")).where(learnable(F.col("doc_id")) & F.col("y").isNotNull())
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    drawn = staged(sample_per_class(known, "doc_id", "y", size))
    texts = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    return texts.join(drawn, "doc_id").groupBy("doc_id", "y", "__weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _make_features():
    def compute(texts):
        found = [LETTERS.findall((t or "").lower()) for t in texts]
        return {"words": pa.array([sorted(features(f)) for f in found], pa.list_(pa.string())),
                "ratios": pa.array(list(shapes(texts, list(map(len, found)), [len(set(f)) for f in found])), pa.list_(pa.float64()))}
    return compute


def train(sample: DataFrame, extra_words: Sequence[str] = (), pairs_of=None, penalty: float = 0.0, **options) -> Model | None:
    """Model of a labelled sample, or None without two classes.

    The words of the model are chosen by an aggregate over the sample: those in at least ``LEAST_DOCUMENTS`` documents
    that depart most from the class shares (chi-square), ``VOCABULARY`` at most. Only the chosen words of the sampled
    documents, bounded by the two parameters, reach the driver. ``pairs_of`` gives counterfactual pairs of word lists for the texts.
    """
    rows = staged(map_texts(sample, "text", {"doc_id": "doc_id", "y": "y", "weight": "__weight"} | ({"text": "text"} if pairs_of else {}), _make_features, "words array<string>, ratios array<double>"))
    shares = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return None
    classes, total = sorted(shares), sum(shares.values())
    counts = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("y") == F.lit(c)).alias(f"n{i}") for i, c in enumerate(classes)])
    chi = sum(((F.col(f"n{i}") - F.col("n") * (shares[c] / total)) ** 2 / (F.col("n") * (shares[c] / total)) for i, c in enumerate(classes)), F.lit(0.0))
    chosen = staged(counts.where((F.col("n") >= LEAST_DOCUMENTS)).orderBy(chi.desc(), "word").limit(VOCABULARY).select("word"))
    words = {w: i for i, w in enumerate(sorted({r["word"] for r in chosen.collect()} | set(extra_words)))}

    def narrow(batches):
        known = set(words)
        for batch in batches:
            lists = [[w for w in ws if w in known] for ws in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.string())), batch.column(3)], names=["y", "weight", "words", "ratios"])

    kind = rows.schema["y"].dataType.simpleString()
    table = rows.select("y", "weight", "words", "ratios", "doc_id").sort("doc_id").drop("doc_id").mapInArrow(narrow, f"y {kind}, weight double, words array<string>, ratios array<double>").toArrow()
    features = Rows.of(table["words"].to_pylist(), table["ratios"].to_pylist(), words)
    label = np.array([classes.index(y) for y in table["y"].to_pylist()])
    pairs = None
    if pairs_of:
        lists = pairs_of(rows)
        if lists:
            pairs = tuple(Rows.of([p[side] for p in lists], np.zeros((len(lists), len(SHAPE))), words) for side in (0, 1))
    return fit(features, label, table["weight"].to_numpy(), classes, words, pairs=pairs, penalty=penalty, **options)
