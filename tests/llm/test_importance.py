"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from limnos.llm import importance


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def buckets_of(text):
    words = words_of(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs, target):
    s, t = Counter(b for _, x in docs for b in buckets_of(x)), Counter(b for x in target for b in buckets_of(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + 10_000.0) / ((s[b] + 1.0) * (total_t + 10_000.0))))
    rows = []
    for i, text in docs:
        found = buckets_of(text)
        weight = math.floor(sum(map(gain, found)) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], n + 1) for n, r in enumerate(able[:25 * len(able) // 100])]
    return drawn, rows


def test_every_awkward_case(spark, odd, odd_rows):
    target = [odd_rows[1][1], "the river and the lake", None, ""]
    table = spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int")
    drawn, rows = plain([(r[0], r[1]) for r in odd_rows], target)
    got = [tuple(r) for r in importance.resample(odd, table).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted((r for r in got if r[4]), key=lambda r: r[4]) == drawn
    assert sorted(map(str, (r[:4] for r in got))) == sorted(map(str, (r[:4] for r in rows)))


def test_empty_tables(spark, odd, empty):
    assert importance.resample(empty, odd).count() == 0
    assert importance.resample(odd, empty).count() == odd.count()


@pytest.mark.parametrize("values", [
    list(range(5000)), [7] * 5000, [1] * 2500 + [2] * 2500, [random.Random(1).randrange(60) for _ in range(5000)],
    [-(2 ** 62)] + [0] * 3000 + [2 ** 62] * 10, [int(random.Random(2).gauss(0, 1e5) ** 3)] * 3 + list(range(-2000, 0))])
def test_cutoffs_by_brackets(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "x long").repartition(4)
    ordered = sorted(values)
    for place in (1, 2, len(values) // 3, len(values) // 2, len(values) - 1, len(values)):
        value = ordered[place - 1]
        assert importance.value_at(rows, F.col("x"), place, accuracy=50, bracket_rows=40) == (value, ordered.index(value))


def test_a_hot_id_is_drawn_in_part(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text)] * 80 + [(2, text)] * 40, "doc_id long, text string").repartition(6)
    ranks = [r["rank"] for r in importance.resample(docs, docs).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 31))
