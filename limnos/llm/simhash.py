"""Near duplicates by SimHash, linked through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at most two bits, some
two of the three segments hold at most one difference: one of them is equal, the other differs in at most one bit
(pigeonhole). So one key is (equal segment, index of a nearby Golay codeword of the other), for each ordered pair of
segments. The perfect binary Golay code of length 23 has exactly one codeword within distance 3 of any word, and words of
distance 1 share the nearest codeword of the one among the codewords within distance 4 of the other (one, or six). Equal keys
are joined and every pair is verified on all 64 bits, so no link is lost and none is false.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from limnos.llm.shared import components, map_texts, one_of_each
from limnos.functions.nulls import col
from limnos.session import staged

SHINGLE = 3
MAX_DIFFERENCE = 2
#: First bit and width of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: generator polynomial of the Golay code.
GENERATOR = 0xC75
#: Keys with more distinct fingerprints than this are linked by shared one-bit neighbours instead of a join of the key.
BUCKET = 64


def fingerprint(text: str | None) -> int:
    """SimHash of all word shingles of a whole text (A-Z in lower case), as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    first, last, digest = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(first), 65_536):
        h = np.array([digest(line[a:b], 42) for a, b in zip(first[at:at + 65_536], last[at:at + 65_536])], np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(first), bitorder="little").view("<u8")[0])


def _make_fingerprints():
    def compute(texts):
        return {"fp": pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), pa.int64())}
    return compute


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and for each syndrome the error patterns of weight up to 4 (-1 where fewer)."""
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    upper = np.array([remainder(i << 11) for i in range(4096)], np.int64)
    patterns = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, int)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            s = int(upper[error >> 11]) ^ (error & 0x7FF)
            patterns[s, filled[s]] = error
            filled[s] += 1
    return upper, patterns


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of words of 23 bits: the nearest first, -1 where there are fewer."""
    upper, patterns = golay()
    errors = patterns[upper[words >> 11] ^ (words & 0x7FF)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def _fuzzy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            signed = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False)
            fp = signed.view(np.uint64)
            parts = [((fp >> np.uint64(b)) & np.uint64((1 << w) - 1)).astype(np.int64) for b, w in SEGMENTS]
            near = [codeword_indices(p) for p in parts]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for combo, (a, b) in enumerate((a, b) for a in range(3) for b in range(3) if a != b):
                row, which = np.nonzero(near[b] >= 0)
                out.append((signed[row], (combo << 34) | (parts[a][row] << 12) | near[b][row, which], which == 0))
            fps, keys, nearest = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(keys), pa.array(nearest)], names=["fp", "key", "nearest"])


def neighbours(fingerprints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``MAX_DIFFERENCE`` bits; ``fingerprints`` has distinct ``fp``.

    A key shared by at most ``BUCKET`` fingerprints is joined with itself and verified. Fingerprints of a larger key
    are linked exactly as well, without its pairs: two words within two bits have a common word within one bit of both, so each emits its
    65 such words, and those that meet at a word (65 at most) are linked to the smallest.
    """
    keys = staged(fingerprints.select("fp").mapInArrow(_fuzzy_keys, "fp long, key long, nearest boolean"))
    sizes = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("nearest").alias("n_near"))
             .where("n > 1 and n_near > 0").select("key", "n"))
    shared = staged(keys.join(sizes, "key"))
    cold = shared.where(F.col("n") <= BUCKET)
    left = cold.where("nearest").select("key", F.col("fp").alias("a"))
    right = cold.select("key", F.col("fp").alias("b"))
    pairs = (left.join(right, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DIFFERENCE))
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    hot = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(v).cast("long") for v in (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64).tolist()])
    words = staged(hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")))
    lowest = words.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("word", "b")
    stars = words.join(lowest, "word").where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def link(rows: DataFrame) -> DataFrame:
    """``fp``, ``root``: a class for each distinct ``fp`` of rows; fingerprints reach each other by links inside a class."""
    distinct = staged(rows.select("fp").distinct())
    found = components(neighbours(distinct)).withColumnRenamed("node", "fp")
    return staged(distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: the smallest id reachable over links.

    Equal fingerprints are one class from the start, so exact copies, however many, are never compared; only
    the ids move with them. A null or blank text has fingerprint zero and links like any other; very long texts count whole. Null ids do not count as smallest; a
    component of null ids only has a null component_id. Repeated rows are rows of one class. An empty table gives an
    empty result; columns beyond the two are not read.
    """
    rows = staged(map_texts(docs, text, {"doc_id": doc_id}, _make_fingerprints, "fp long"))
    classes = link(rows)
    lowest = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    ids = lowest.join(classes, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    named = staged(classes.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with its own columns, whatever their names: the smallest id, null last, then the smallest hash of its text."""
    named = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), F.xxhash64(col(text)).alias("hash"))
    names = staged(map_texts(named, "text", {"doc_id": "doc_id", "hash": "hash"}, _make_fingerprints, "fp long"))
    return one_of_each(docs, names, link(names), doc_id, text)
