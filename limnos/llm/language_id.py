"""Language of a text by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. A word has many segmentations into pieces; its
probability is the sum over all of them, found by a forward algorithm, and a text is the product of its words. The piece
probabilities are fitted to the words of each language by forward-backward counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from limnos.functions.nulls import col
from limnos.llm.shared import held_out, learnable, map_texts, sample_per_class

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Documents of each language the probabilities are fitted to, on average.
TRAIN_DOCUMENTS = 300
ROUNDS = 4
#: Letters up to which the probability of a word is summed as it is; that of a longer run is summed in logarithms, where it cannot underflow.
PLAIN = 32
#: Letters of the words whose spans are looked up at once.
LATTICE = 660_000
#: Probability of a letter that is no piece, and the least of any piece.
FLOOR = 1e-8
UNKNOWN = "und"
#: Distinct words a task remembers; beyond, it forgets them and scores again.
REMEMBERED = 400_000
LETTERS = regex.compile(r"\p{L}+")
START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces(NamedTuple):
    """Pieces sorted by a hash of their letters; ``longest`` is the most letters of a piece."""
    hashes: np.ndarray
    longest: int

    @property
    def size(self) -> int:
        return len(self.hashes)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """The text pieces of a sentence-piece vocabulary, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    hashes = np.zeros(len(texts), np.uint64)
    with np.errstate(over="ignore"):
        for i, text in enumerate(texts):
            h = np.uint64(0)
            for c in text:
                h = h * _BASE + np.uint64(ord(c) + 1)
            hashes[i] = h
    unique = np.unique(hashes)
    if len(unique) != len(texts):
        raise ValueError("two pieces share a hash")
    return Pieces(unique, max(map(len, texts)))


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, however long."""
    return LETTERS.findall((text or "").lower())


def lattices(words: Sequence[str], vocabulary: Pieces) -> Iterator[tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]]:
    """For the words of each length: their numbers, and the piece of every span (start, letters).

    The number of a piece is its place in the vocabulary; ``size`` stands for a letter that is no piece and ``size + 1``
    for a longer span that is none.
    """
    marked = [START + w for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    for m in np.unique(lengths).tolist():
        every = np.nonzero(lengths == m)[0]
        step = max(1, LATTICE // m)
        for at in range(0, len(every), step):
            rows = every[at:at + step]
            codes = np.frombuffer("".join([marked[r] for r in rows]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), m).astype(np.uint64) + np.uint64(1)
            spans = {}
            for i in range(m):
                h = np.zeros(len(rows), np.uint64)
                for k in range(1, min(vocabulary.longest, m - i) + 1):
                    h = h * _BASE + codes[:, i + k - 1]
                    at_piece = np.minimum(np.searchsorted(vocabulary.hashes, h), vocabulary.size - 1)
                    spans[i, k] = np.where(vocabulary.hashes[at_piece] == h, at_piece, vocabulary.size + (k > 1))
            yield rows, spans


def forward(spans: dict[tuple[int, int], np.ndarray], table: np.ndarray) -> list[np.ndarray]:
    """Probability of each beginning of the words, summed over its segmentations; one column per language."""
    n, m = len(spans[0, 1]), max(i + k for i, k in spans)
    alpha = [np.ones((n, table.shape[1]))]
    for j in range(1, m + 1):
        total = np.zeros((n, table.shape[1]))
        for i in range(j):
            if (i, j - i) in spans:
                total += alpha[i] * table[spans[i, j - i]]
        alpha.append(total)
    return alpha


def log_forward(spans: dict[tuple[int, int], np.ndarray], log_table: np.ndarray) -> list[np.ndarray]:
    """Logarithms of the same for runs of any length."""
    n, m = len(spans[0, 1]), max(i + k for i, k in spans)
    longest = max(k for _, k in spans)
    alpha = [np.zeros((n, log_table.shape[1]))]
    for j in range(1, m + 1):
        ways = [alpha[i] + log_table[spans[i, j - i]] for i in range(max(0, j - longest), j)]
        alpha.append(np.logaddexp.reduce(ways))
    return alpha


def log_of(table: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(table)


def fit(words: Sequence[str], counts: np.ndarray, vocabulary: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language (with those of no piece behind them) from its words and their counts."""
    size = vocabulary.size
    prob = np.full(size + 2, 1.0 / size)
    prob[size], prob[size + 1] = FLOOR, 0.0
    lattice = list(lattices(words, vocabulary))
    for _ in range(rounds):
        expected = np.zeros(size + 2)
        for rows, spans in lattice:
            m = max(i + k for i, k in spans)
            if m > PLAIN + 1:
                _expect_long(spans, prob, counts[rows], expected)
                continue
            alpha = [a[:, 0] for a in forward(spans, prob[:, None])]
            beta = [np.zeros(len(rows)) for _ in range(m)] + [np.ones(len(rows))]
            for i in range(m - 1, -1, -1):
                for k in range(1, m - i + 1):
                    if (i, k) in spans:
                        beta[i] += prob[spans[i, k]] * beta[i + k]
            weight = counts[rows] / alpha[m]
            for (i, k), piece in spans.items():
                expected += np.bincount(piece, alpha[i] * prob[piece] * beta[i + k] * weight, size + 2)
        prob[:size] = np.maximum((expected[:size] + 1e-3) / (expected[:size].sum() + 1e-3 * size), FLOOR)
    return prob


def _expect_long(spans: dict[tuple[int, int], np.ndarray], prob: np.ndarray, counts: np.ndarray, expected: np.ndarray) -> None:
    """Add the expected pieces of long runs: forward and backward sums in logarithms."""
    log_prob = log_of(prob)
    alpha = [a[:, 0] for a in log_forward(spans, log_prob[:, None])]
    m, longest = len(alpha) - 1, max(k for _, k in spans)
    beta = [np.zeros(len(counts)) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([log_prob[spans[i, k]] + beta[i + k] for k in range(1, min(longest, m - i) + 1)])
    for (i, k), piece in spans.items():
        expected += np.bincount(piece, np.exp(alpha[i] + log_prob[piece] + beta[i + k] - alpha[m]) * counts, len(expected))


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray
    path: str


class Scorer:
    """Log probabilities of words under all languages; remembers distinct words up to ``REMEMBERED``."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, pieces(model.path)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def learn(self, new: list[str]) -> None:
        scores = np.zeros((len(new), len(self.model.languages)))
        for rows, spans in lattices(new, self.vocabulary):
            long = max(i + k for i, k in spans) > PLAIN + 1
            scores[rows] = log_forward(spans, log_of(self.model.table))[-1] if long else np.log(forward(spans, self.model.table)[-1])
        self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
        self.scores = np.concatenate((self.scores, scores))

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.scores = self.scores[:0]
        words = [words_of(t) for t in texts]
        found = [list(map(self.known.get, w)) for w in words]
        missing = dict.fromkeys([w for ws, rows in zip(words, found) if None in rows for w, r in zip(ws, rows) if r is None])
        if missing:
            self.learn(list(missing))
        langs, scores = [], []
        for ws, rows in zip(words, found):
            if not ws or not self.model.languages:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            if None in rows:
                rows = list(map(self.known.get, ws))
            total = self.scores[np.array(rows)].sum(axis=0)
            best = int(total.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", path: str = VOCABULARY,
          size: int = TRAIN_DOCUMENTS) -> Model:
    """Model of the languages of the learnable documents.

    Fitted to about ``size`` documents of each language, drawn by a hash of the id; one task fits one language from its
    counted words. The table, one number per language and piece, is all that reaches the driver.
    """
    known = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"))
    drawn = sample_per_class(known.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull()), "doc_id", "lang", size)

    def make():
        return lambda texts: {"words": pa.array([words_of(t) for t in texts], pa.list_(pa.string()))}

    words = map_texts(drawn, "text", {"lang": "lang"}, make, "words array<string>").select("lang", F.explode("words").alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))

    def fit_language(key: tuple, rows: pa.Table) -> pa.Table:
        table = rows.sort_by("word")
        prob = fit(table["word"].to_pylist(), table["n"].to_numpy().astype(float), pieces(path))
        return pa.table({"lang": [key[0].as_py()], "prob": pa.array([prob], pa.list_(pa.float64()))})

    fitted = counted.groupBy("lang").applyInArrow(fit_language, "lang string, prob array<double>").orderBy("lang").collect()
    table = np.array([r["prob"] for r in fitted]).T if fitted else np.zeros((0, 0))
    return Model([r["lang"] for r in fitted], table, path)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: the likeliest language of each whole text and its probability.

    All languages are equally likely before the text is seen; very long texts and words count whole; equal ones give the first in the alphabet. A null text, one
    without a letter, or a model without languages gives 'und' and score 0. Repeated rows and null ids are rows like
    any other (a null id is not held out, nor learned from). An empty table gives an empty result; no other column is read.
    """
    def make():
        scorer = Scorer(model)

        def compute(texts):
            langs, scores = scorer.predict(texts)
            return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
        return compute

    found = map_texts(docs, text, {"doc_id": doc_id}, make, "lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
