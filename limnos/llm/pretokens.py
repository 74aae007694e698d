"""Byte-level pre-tokens and pair tables of public vocabularies, shared by encoding and counting."""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import regex

#: Splits a text into the pieces that are merged separately.
PIECES = regex.compile(public_tokenizers.PATTERN.replace("'s|'t|'re|'ve|'m|'ll|'d", "'(?:[stmd]|re|ve|ll)"))  # the same, tried once
#: No pair of this rank exists.
NO_RANK = np.int64(1) << 40


class Pairs(NamedTuple):
    """Adjacent ids that may merge: sorted keys ``left * n + right``, their ranks and the ids they become."""
    n: int
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray
    tokens: list[bytes]
    ids: dict[bytes, int]

    def rank_and_id(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NO_RANK), self.merged[at]


def _table(tokens: list[bytes], pairs: list[tuple[int, int, int, int]]) -> Pairs:
    ids = {t: i for i, t in enumerate(tokens)}
    n = len(tokens)
    table = np.array(pairs, np.int64).reshape(-1, 4)
    keys = table[:, 0] * n + table[:, 1]
    order = np.argsort(keys, kind="stable")
    return Pairs(n, keys[order], table[order, 2], table[order, 3], np.array([ids[bytes([b])] for b in range(256)], np.int64), tokens, ids)


@lru_cache(2)
def rank_pairs(path: str) -> Pairs:
    """From a rank file: any two tokens whose bytes join to a token merge, at the rank of that token."""
    with open(path, "rb") as file:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file))
    tokens = [t for _, t in ranked]
    if [r for r, _ in ranked] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2 ...")
    ids = {t: i for i, t in enumerate(tokens)}
    return _table(tokens, [(ids[t[:i]], ids[t[i:]], rank, rank) for rank, t in enumerate(tokens)
                           for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids])


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a JSON vocabulary: printable ones themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def merge_pairs(path: str) -> tuple[Pairs, tuple[str, ...]]:
    """From a JSON tokenizer: the listed merges in their order, and the special strings it finds inside texts."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letter, vocab = byte_letters(), spec["model"]["vocab"]
    tokens: list[bytes] = [b""] * (max(vocab.values()) + 1)
    for word, i in vocab.items():
        tokens[i] = bytes(letter[c] for c in word)
    pairs = []
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        pairs.append((vocab[left], vocab[right], rank, vocab[left + right]))
    return _table(tokens, pairs), tuple(t["content"] for t in spec["added_tokens"])
