"""Byte-level BPE: whole texts to ids and back.

Each pre-token is merged by itself. A segment tree over its byte positions holds at every node the least (rank, position) of
the pairs that start below it, so the root is the leftmost pair of minimum rank. A merge writes the new symbol at
the left position, links it with its next live neighbour, and updates three leaves and their ancestors: the merged pair,
the pair before it, and the dead right position. Short pre-tokens are merged many at a time, one tree per row of an
array; a long one has a tree of its own in a list. Distinct pre-tokens of a task are merged once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from limnos.functions.nulls import col
from limnos.llm.pretokens import NO_RANK, PIECES, Pairs, rank_pairs
from limnos.llm.shared import map_texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pre-tokens up to this many bytes are merged in arrays.
SHORT = 64
#: Distinct pre-tokens a task remembers; beyond, it forgets them and merges again.
REMEMBERED = 200_000


def encode_rows(words: Sequence[bytes], pairs: Pairs) -> list[list[int]]:
    """Ids of pre-tokens of 1 to ``SHORT`` bytes; one segment tree per row."""
    out: list[list[int]] = [[]] * len(words)
    lengths = np.array([len(w) for w in words], np.int64)
    size = 2
    while size // 2 < SHORT:
        rows = np.nonzero((lengths <= size) & ((lengths > size // 2) | (size == 2)))[0]
        for at in range(0, len(rows), 32_768):
            some = rows[at:at + 32_768]
            for row, ids in zip(some.tolist(), _merge([words[r] for r in some], lengths[some], size, pairs)):
                out[row] = ids
        size *= 2
    return out


def _merge(words: list[bytes], lengths: np.ndarray, size: int, pairs: Pairs) -> list[list[int]]:
    """Trees, symbols and links of all rows lie behind each other in flat arrays; a spot is row * size + position."""
    n = len(words)
    raw = np.frombuffer(b"".join([w.ljust(size, b"\0") for w in words]), np.uint8)
    symbol = pairs.byte_ids[raw]
    place = np.tile(np.arange(size), n)
    spots = np.arange(n * size)
    long = np.repeat(lengths, size)
    live = place < long
    follow = np.where(place + 1 < long, spots + 1, -1)  # next live spot, -1 for none
    before = np.where(place > 0, spots - 1, -1)
    none = NO_RANK * size
    tree = np.full((n, 2 * size), none, np.int64)
    rank, _ = pairs.rank_and_id(symbol, np.roll(symbol, -1))
    tree[:, size:] = np.where((follow >= 0) & (rank < NO_RANK), rank * size + place, none).reshape(n, size)
    for level in range(size.bit_length() - 2, -1, -1):
        a, b = 1 << level, 2 << level
        tree[:, a:b] = np.minimum(tree[:, 2 * a:2 * b:2], tree[:, 2 * a + 1:2 * b:2])
    node = tree.reshape(-1)

    def leaves(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Leaf values of pairs of spots, where a spot may be missing."""
        r, _ = pairs.rank_and_id(symbol[left], symbol[right])
        return np.where((left >= 0) & (right >= 0) & (r < NO_RANK), r * size + left % size, none)

    row = np.nonzero(tree[:, 1] < none)[0]
    while len(row):
        least = node[row * (2 * size) + 1]
        left = row * size + least % size
        right = follow[left]
        symbol[left] = pairs.rank_and_id(symbol[left], symbol[right])[1]
        live[right] = False
        after, prior = follow[right], before[left]
        follow[left] = after
        linked = after >= 0
        before[after[linked]] = left[linked]
        back = prior >= 0
        touched = np.concatenate((right, left, prior[back]))
        root = touched // size * (2 * size)
        at = size + touched % size
        node[root + at] = np.concatenate((np.full(len(row), none), leaves(left, after), leaves(prior[back], left[back])))
        for _ in range(size.bit_length() - 1):
            at >>= 1
            child = root + 2 * at
            node[root + at] = np.minimum(node[child], node[child + 1])
        row = row[node[row * (2 * size) + 1] < none]
    flat, counts = symbol[live].tolist(), live.reshape(n, size).sum(axis=1).tolist()
    out, start = [], 0
    for k in counts:
        out.append(flat[start:start + k])
        start += k
    return out


def encode_long(word: bytes, pairs: Pairs) -> list[int]:
    """Ids of one pre-token of any length, in n log n steps."""
    n, ids, tokens = len(word), pairs.ids, pairs.tokens
    size = 1 << max(1, (n - 1).bit_length())
    end, none = n, (int(NO_RANK), n)
    symbol = pairs.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    follow, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def leaf(i: int) -> tuple[int, int]:
        if i < 0 or follow[i] >= end:
            return none
        rank = ids.get(tokens[symbol[i]] + tokens[symbol[follow[i]]])
        return none if rank is None else (rank, i)

    tree = [none] * size + [leaf(i) for i in range(n)] + [none] * (size - n)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def update(i: int, value: tuple[int, int]) -> None:
        at = size + i
        tree[at] = value
        at >>= 1
        while at:
            least = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == least:
                return  # nothing above changes
            tree[at] = least
            at >>= 1

    while tree[1] != none:
        rank, left = tree[1]
        right = follow[left]
        symbol[left], live[right], follow[left] = rank, False, follow[right]
        if follow[right] < end:
            before[follow[right]] = left
        update(right, none)
        update(left, leaf(left))
        if before[left] >= 0:
            update(before[left], leaf(before[left]))
    return [s for s, alive in zip(symbol, live) if alive]


class Encoder:
    """Encodes and decodes the whole texts of a task; remembers distinct pre-tokens up to ``REMEMBERED``.

    The ids of a pre-token are kept as decimal text and their decoded bytes beside them: plain byte strings, which cost
    a garbage collector nothing.
    """

    def __init__(self, path: str = RANKS):
        self.pairs = rank_pairs(path)
        self.decimal: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.decimals = [b"%d" % i for i in range(self.pairs.n)]

    def learn(self, new: list[str]) -> None:
        """Merge pre-tokens not seen before."""
        raw = [p.encode("utf-8") for p in new]
        whole = [self.pairs.ids.get(b) for b in raw]  # a pre-token that is a token is that token
        short = [i for i, b in enumerate(raw) if whole[i] is None and len(b) <= SHORT]
        coded: list[list[int] | None] = [None if w is None else [w] for w in whole]
        for i, ids in zip(short, encode_rows([raw[i] for i in short], self.pairs)):
            coded[i] = ids
        for piece, b, ids in zip(new, raw, coded):
            if ids is None:
                ids = encode_long(b, self.pairs)
            self.decimal[piece] = b" ".join([self.decimals[i] for i in ids])
            self.decoded[piece] = self.decode(ids)

    def decode(self, ids: Sequence[int]) -> bytes:
        tokens = self.pairs.tokens
        return b"".join([tokens[i] for i in ids])

    def rows(self, texts: Sequence[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each text as decimals joined by blanks, and the bytes they decode to."""
        if len(self.decimal) > REMEMBERED:
            self.decimal.clear()
            self.decoded.clear()
        pieces = [PIECES.findall(t) if t else [] for t in texts]
        found = [list(map(self.decimal.get, p)) for p in pieces]
        missing = dict.fromkeys([p for ps, ids in zip(pieces, found) if None in ids for p, x in zip(ps, ids) if x is None])
        if missing:
            self.learn(list(missing))
        get, decoded = self.decimal.get, self.decoded.__getitem__
        for ps, ids in zip(pieces, found):
            if None in ids:
                ids = list(map(get, ps))
            yield b" ".join(ids), b"".join(map(decoded, ps))

    def encode(self, text: str | None) -> list[int]:
        ids, _ = next(self.rows([text]))
        return list(map(int, ids.split()))


def _digests(path: str):
    def make():
        encoder = Encoder(path)

        def compute(texts):
            rows = [(ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    for ids, decoded in encoder.rows(texts)]
            counts, ids, decoded = zip(*rows)
            return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        return compute
    return make


def encode_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids of each text, and of the bytes they decode to.

    A null text counts as empty: no ids, and the digest of nothing. Repeated rows and null ids are rows like any
    other. Special strings are plain text. An empty table gives an empty result; columns beyond the two are not read.
    """
    return map_texts(docs, text, {"doc_id": doc_id}, _digests(path), "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str):
    def make():
        encoder = Encoder(path)

        def compute(texts):
            flat, same = [], []
            for text, (ids, decoded) in zip(texts, encoder.rows(texts)):
                flat.append(np.array(ids.split(), np.int32))
                same.append(decoded == (text or "").encode("utf-8"))
            return {"ids": pa.array(flat, pa.list_(pa.int32())), "n_tokens": pa.array([len(f) for f in flat], pa.int64()), "restored": pa.array(same, pa.bool_())}
        return compute
    return make


def encode_texts(docs: DataFrame, keep: dict[str, str], text: str = "text", path: str = RANKS) -> DataFrame:
    """Kept columns, ``ids`` (the tokens of the text), ``n_tokens`` and ``restored`` (the ids decode to the text's bytes)."""
    return map_texts(docs, text, keep, _ids(path), "ids array<int>, n_tokens long, restored boolean")


def decode_ids(rows: DataFrame, ids: str = "ids", keep: dict[str, str] | None = None, path: str = RANKS) -> DataFrame:
    """Texts of id lists; null for a null list. Bytes that are not UTF-8 become U+FFFD."""
    kept = rows.select(col(ids).cast("array<int>").alias("__ids"), *[col(c).alias(n) for n, c in (keep or {}).items()])
    schema = T.StructType([*kept.schema.fields[1:], T.StructField("text", T.StringType())])

    def run(batches):
        tokens = rank_pairs(path).tokens
        for batch in batches:
            texts = [None if x is None else b"".join([tokens[i] for i in x]).decode("utf-8", "replace") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)
