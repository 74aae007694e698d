"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, shard string, __q long"
SENTENCES = {
    "en": "the river of the north and the lake in the hills with water from the snow",
    "de": "der fluss und das wasser im tal mit dem schnee von den bergen nicht weit",
    "fr": "la rivière et le lac dans les montagnes avec une eau pour les villes du nord",
}


def sentence(lang: str, i: int, words: int = 14) -> str:
    parts = SENTENCES[lang].split()
    return " ".join(parts[(i * 7 + j * (1 + i % 5)) % len(parts)] for j in range(words)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_rows():
    rows = [(i, sentence(("en", "de", "fr")[i % 3], i, 14 + i % 9), ("en", "de", "fr")[i % 3], f"s{i % 2}") for i in range(60)]
    rows += [(100 + i, rows[0][1], "en", "s0") for i in range(20)]
    rows += [(200, None, "en", "s0"), (201, "", None, None), (202, " \t\n", "en", "s1"), (203, "one", "en", "s1"), (204, "12 34 !!", None, "s1"),
             (205, "x" * 5_000, "en", "s0"), (206, "word " * 30_000, "en", "s0"), (207, "日本語 テキスト 🎉 ß \x1c é", None, "s1"),
             (208, "<|endoftext|> a <|endoftext|>", None, "s1"), (None, "a text without an id of ten words or more than that here", "en", "s1"),
             (None, "a text without an id of ten words or more than that here", "en", "s1"), (0, rows[0][1], "en", "s0"), (0, "another text of the same id", "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.5, "x", "y", 1) for r in odd_rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, odd):
    return odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"), F.lit(1).alias("text"))
