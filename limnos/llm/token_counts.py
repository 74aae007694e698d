"""Token counts by rank-synchronous array merging.

Batched pre-tokens are one ragged array of symbols. In each round every sequence finds the lowest rank among its pairs
and merges all pairs of that rank at once, from the left where they overlap; a merge can only make pairs of higher rank, so
this gives what one merge at a time would. Sequences without a pair left leave the array; their symbols are the count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from limnos.llm.pretokens import NO_RANK, PIECES, Pairs, merge_pairs
from limnos.llm.shared import map_texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512
#: Distinct pre-tokens a task remembers; beyond, it forgets them and counts again.
REMEMBERED = 500_000
#: Bytes of pre-tokens merged together.
BATCH_BYTES = 4_000_000


def count_symbols(words: Sequence[bytes], pairs: Pairs) -> np.ndarray:
    """Symbols that survive the merges of each word (of at least one byte)."""
    sizes = np.array([len(w) for w in words], np.int64)
    counts = sizes.copy()
    symbol = pairs.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)  # numbers of the words still in the array
    rank, merged = _adjacent(symbol, owner, pairs)
    while len(symbol):
        starts = np.concatenate(([0], np.nonzero(np.diff(owner))[0] + 1))
        lengths = np.diff(np.append(starts, len(symbol)))
        least = np.minimum.reduceat(rank, starts)
        open_ = least < NO_RANK
        done = ~open_
        counts[owner[starts[done]]] = lengths[done]
        stay = np.repeat(open_, lengths)
        symbol, owner, rank, merged, low = symbol[stay], owner[stay], rank[stay], merged[stay], np.repeat(least, lengths)[stay]
        if not len(symbol):
            break
        hit = rank == low
        spot = np.arange(len(symbol))
        first = hit & ~np.concatenate(([False], hit[:-1] & (owner[1:] == owner[:-1])))
        run = np.maximum.accumulate(np.where(first, spot, -1))  # where the run of overlapping pairs began
        take = hit & ((spot - run) % 2 == 0)
        symbol = np.where(take, merged, symbol)
        keep = ~np.concatenate(([False], take[:-1]))
        touched = take | np.concatenate((take[2:], [False, False])) | np.concatenate((take[1:], [False]))
        symbol, owner, rank, merged, touched = symbol[keep], owner[keep], rank[keep], merged[keep], touched[keep]
        # Only pairs beside a new symbol have to be looked up again.
        again = touched | np.concatenate((touched[1:], [False]))
        at = np.nonzero(again)[0]
        rank[at], merged[at] = _pairs_at(symbol, owner, at, pairs)
    return counts


def _pairs_at(symbol: np.ndarray, owner: np.ndarray, at: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    after = np.minimum(at + 1, len(symbol) - 1)
    rank, merged = pairs.rank_and_id(symbol[at], symbol[after])
    return np.where((after > at) & (owner[at] == owner[after]), rank, NO_RANK), merged


def _adjacent(symbol: np.ndarray, owner: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    return _pairs_at(symbol, owner, np.arange(len(symbol)), pairs)


class Counter:
    """Counts tokens of whole texts; remembers distinct pre-tokens up to ``REMEMBERED``."""

    def __init__(self, path: str = VOCABULARY):
        self.pairs, special = merge_pairs(path)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def learn(self, new: list[str]) -> None:
        """Count the symbols of pre-tokens not seen before."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        raw = [p.encode("utf-8") for p in new]
        start = size = 0
        for i, word in enumerate(raw):
            size += len(word)
            if size >= BATCH_BYTES or i + 1 == len(raw):
                self.known.update(zip(new[start:i + 1], count_symbols(raw[start:i + 1], self.pairs).tolist()))
                start, size = i + 1, 0

    def count(self, texts: Sequence[str | None]) -> list[int]:
        """Tokens of each text; a special string inside a text is one token, and parts the text."""
        pieces, specials = [], []
        for text in texts:
            text = text or ""
            parts = self.special.split(text) if self.special else [text]
            specials.append(len(parts) - 1)
            pieces.append(PIECES.findall(text) if len(parts) == 1 else [p for part in parts for p in PIECES.findall(part)])
        found = [list(map(self.known.get, p)) for p in pieces]
        missing = dict.fromkeys([p for ps, counts in zip(pieces, found) if None in counts for p, c in zip(ps, counts) if c is None])
        if missing:
            self.learn(list(missing))
            get = self.known.get
            found = [[c or get(p) for p, c in zip(ps, counts)] if None in counts else counts for ps, counts in zip(pieces, found)]
        return [n + sum(counts) for n, counts in zip(specials, found)]


@lru_cache(1)
def counter(path: str) -> Counter:
    """One counter for all tasks of a worker process."""
    return Counter(path)


def _counts(path: str, limit: int):
    def make():
        def compute(texts):
            n = counter(path).count(texts)
            return {"n_bytes": pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array([k > limit for k in n], pa.bool_())}
        return compute
    return make


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each whole text.

    A null text counts as empty: no bytes and no tokens. A very long text is a slice of its own and counted whole. Repeated rows and null ids are rows like any other. An
    empty table gives an empty result; columns beyond the two are not read.
    """
    return map_texts(docs, text, {"doc_id": doc_id}, _counts(path, limit), "n_bytes long, n_tokens long, over_limit boolean")
