"""Importance resampling of documents towards the distribution of a target set.

Features are runs of words, hashed into a fixed number of buckets. A bucket's gain is the smoothed log ratio of its share
in the target to its share in the documents, a document's weight the mean gain of its features, looked up as an array. Adding
Gumbel noise from a digest of the id and taking the largest sums draws without replacement in proportion to the weights.

The cutoff is found without sorting the documents: a mergeable quantile sketch gives a bracket around its rank, exact counts
on both sides prove the bracket or widen it, and only the rows of a proven bracket are looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.nulls import col
from limnos.llm.shared import map_texts, numbered_in_place, text_slices
from limnos.session import staged

BUCKETS = 10_000
GRAMS = 2
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Relative accuracy of the sketch is one part in so many; the first bracket is ten times as wide.
ACCURACY = 10_000
#: A bracket of at most so many rows is sorted.
BRACKET_ROWS = 10_000
#: Letters, digits and bytes of other characters stay (A-Z in lower case); the rest parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_hashes(text: str | None, grams: int = GRAMS) -> tuple[int, np.ndarray]:
    """Number of words of a whole text, and the CRC-32 of every run of up to ``grams`` words, joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    if not words:
        return 0, np.zeros(0, np.int64)
    spaced = b" ".join(words).replace(b" ", b"\n ").split(b"\n")
    runs = [list(map(crc32, words))]
    for k in range(1, min(grams, len(words))):
        runs.append(list(map(crc32, spaced[k:], runs[-1])))  # a run's checksum goes on from the run without its last word
    return len(words), np.fromiter(chain.from_iterable(runs), np.int64, sum(map(len, runs)))


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """``bucket``, ``n``: features in each bucket over all texts. A task sends one row per bucket, whatever its rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in text_slices(batch, 0):
                for t in part:
                    total += np.bincount(feature_hashes(t, grams)[1] % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    return texts.select(col(text).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket from the counts of both sides; ``buckets`` numbers, whatever the size of the tables."""
    def dense(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in counts.collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = dense(documents), dense(target)
    share = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in share.tolist()], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", grams: int = GRAMS) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of each whole text's features, 0 without one."""
    def make():
        def compute(texts):
            found = [feature_hashes(t, grams) for t in texts]
            return {"n_words": pa.array([n for n, _ in found], pa.int64()), "n_features": pa.array([len(h) for _, h in found], pa.int64()),
                    "weight": pa.array([int(gain[h % len(gain)].sum()) // len(h) if len(h) else 0 for _, h in found], pa.int64())}
        return compute

    return map_texts(docs, text, {"doc_id": doc_id}, make, "n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandfold Gumbel noise, floored, from a digest of seed and id (a null id counts as an empty one)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def value_at(rows: DataFrame, value: Column, place: int, accuracy: int = ACCURACY, bracket_rows: int = BRACKET_ROWS) -> tuple[int, int]:
    """The ``place``-th smallest value (from 1) of a column of longs without nulls, and the number of rows below it.

    Each round asks a sketch for two values around the place and counts the rows below, at, between and at them exactly. A place outside
    widens the bracket; one at an end is the answer; one between goes on with the rows between. ``rows`` should be a written table.
    """
    now, before = rows.select(value.alias("v")), 0
    left = now.count()
    while left > bracket_rows:
        spread = 10 / accuracy
        while True:
            at = (place - before) / left
            low, high = now.agg(F.percentile_approx("v", [max(0.0, at - spread), min(1.0, at + spread)], accuracy)).first()[0]
            v = F.col("v")
            under, at_low, between, at_high = now.agg(F.count_if(v < low), F.count_if(v == low), F.count_if((v > low) & (v < high)), F.count_if((v == high) & (v > low))).first()
            rank = place - before - under
            if 0 < rank <= at_low + between + at_high:
                break
            spread *= 4
        if rank <= at_low:
            return low, before + under
        if rank > at_low + between:
            return high, before + under + at_low + between
        now, before, left = now.where((F.col("v") > low) & (F.col("v") < high)), before + under + at_low, between
    ordered = [r["v"] for r in now.orderBy("v").collect()]  # at most bracket_rows numbers
    found = ordered[place - before - 1]
    return found, before + sum(x < found for x in ordered)


def first_rows(rows: DataFrame, order: list[Column], take: int) -> Column:
    """Condition of the first ``take`` rows by columns of longs, the last of which tells all rows apart."""
    chosen, tied = F.lit(False), F.lit(True)
    for value in order:
        cut, below = value_at(rows.where(tied), value, take)
        chosen = chosen | (tied & (value < cut))
        tied, take = tied & (value == cut), take - below
    return chosen | tied


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` of every document; ``rank`` is null where it is not drawn.

    Of the documents with at least ``least_words`` words the ``percent`` hundredths with the highest scores are drawn; ties go to the
    smaller id (integers are expected), a null id last. Repeated rows are documents of their own with one score, so some copies of an id may be drawn and others not; which ones
    does not show. A null or empty text has no feature, weight 0, and is not drawn. Very long texts are read whole. An empty target
    gives the gains of its smoothing alone; an empty table gives an empty result; other columns are not read.
    """
    gain = gains(bucket_counts(docs, text, buckets, grams), bucket_counts(target, target_text, buckets, grams), buckets)
    weighed = weigh(docs, gain, doc_id, text, grams).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = staged(weighed.withColumn("at", F.monotonically_increasing_id()))
    long_enough = F.col("n_words") >= least_words
    take = percent * scored.where(long_enough).count() // 100
    shown = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    if take == 0:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(shown)
    order = [-F.col("score"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.col("at")]
    drawn = long_enough & first_rows(scored.where(long_enough), order, take)
    ranked = numbered_in_place(scored.where(drawn).repartitionByRange(*order).sortWithinPartitions(*order), "rank", 1)
    return ranked.select(shown).unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(shown))
