"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from limnos.llm import (bpe, conversation_repair, embedding_dedup, importance, language_id, mixing, neighbour_graph, quality_rules, sharding, simhash, site_quality,
                        token_counts, toxicity)
from limnos.llm.quality_rules import STOP_FORMS, SYMBOLS
from limnos.sources.driver_tables import table

SHARDS = 8
NEAREST = 5
#: Shares of the tokens the mixed corpus should have.
MIX_WEIGHTS = {mixing.CLEAN: 0.9, mixing.POOR: 0.08, mixing.TOXIC: 0.02}


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    equal = lambda n: {s: 1.0 for s in range(n)}
    return sharding.shard_documents(table(spark, folder, "documents"), equal(SHARDS), equal(SHARDS + 1))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.score_rules(table(spark, folder, "documents")).drop("mean_word_length", "symbols_per_word", "duplicate_line_ratio")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.similar_vectors(table(spark, folder, "embeddings"))


def op7_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The source of a document is its host, the language section its path."""
    docs = table(spark, folder, "documents")
    model = site_quality.train(docs, table(spark, folder, "labels"))
    return site_quality.site_posteriors(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(table(spark, folder, "documents"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = mixing.train(docs, table(spark, folder, "labels"), mixing.domain_of())
    return mixing.mix_rates(docs, model, MIX_WEIGHTS)


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, folder, "conversations")))


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth vector is a query."""
    vectors = table(spark, folder, "embeddings")
    return neighbour_graph.search(neighbour_graph.build(vectors), vectors.where("vec_id % 50 = 0"), NEAREST)


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_sharding, op3_simhash, op4_quality_rules, op5_toxicity, op6_embedding_dedup, op7_site_quality, op8_byte_bpe,
    op9_mixing, op10_token_counts, op11_conversation_repair, op12_nearest_neighbours, op13_importance)}

_DRAW = "CAST(CAST(('0x' || substr(md5({0}), 1, 13)) AS BIGINT) AS DOUBLE)"


def _shard_sql(shards: int) -> str:
    costs = ", ".join("{'cost': -ln((" + _DRAW.format(f"key || ':{s}'") + f" + 0.5) / 4503599627370496.0), 'shard': {s}}}" for s in range(shards))
    return f"list_sort([{costs}])[1].shard"


_BITS = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

_CRC_TABLE = f"""RECURSIVE crc_table(i, bit, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, bit + 1, {_BITS} FROM crc_table WHERE bit < 8),
crcs AS (SELECT list(c ORDER BY i) AS crc FROM crc_table WHERE bit = 8)"""


def _crc_sql(h: str) -> str:
    """CRC-32 of the bytes whose hexadecimal digits are ``h``."""
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(CAST(length({h}) // 2 AS BIGINT)), lambda i: CAST(('0x' || array_slice({h}, 2 * i + 1, 2 * i + 2)) AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), CAST(4294967295 AS BIGINT))"""


SHARDING_SQL = f"""
WITH {_CRC_TABLE},
texts AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
  SELECT doc_id, key, size, {_crc_sql("h")} AS text_crc32
  FROM texts, crcs),
placed AS (
  SELECT doc_id, size, text_crc32, CAST({_shard_sql(8)} AS INTEGER) AS shard, CAST({_shard_sql(9)} AS INTEGER) AS grown_shard,
    {_DRAW.format("key || ':' || CAST(text_crc32 AS VARCHAR)")} AS spot FROM summed)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY spot, doc_id, text_crc32, size) - 1 AS slot FROM placed"""

_SPACE = "[\\x20\\x09-\\x0D]"
_STOPS = ", ".join(f"'{w}'" for w in STOP_FORMS)

RULES_SQL = f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
numbered AS (SELECT row_number() OVER () AS r, * FROM split),
grams AS (SELECT r, unnest(range(1, greatest(len(words) - 3, 1))) AS i, words FROM numbered),
hashed AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS g FROM grams),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM hashed) WHERE n > 1),
gaps AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS gap FROM twice),
repeats AS (SELECT r, sum(gap) AS n FROM gaps GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_filter(words, lambda w: w IN ({_STOPS}))) AS BIGINT) AS stop_words
  FROM numbered LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, stop_words, base_failed,
  NOT base_failed AND word_chars / CAST(n_words AS DOUBLE) BETWEEN 1.5 AND 20 AND n_symbols / CAST(n_words AS DOUBLE) <= 0.5
    AND stop_words >= 1 AND n_dup_lines / CAST(n_lines AS DOUBLE) <= 0.5 AS kept FROM judged"""

_RUNS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

IMPORTANCE_SQL = f"""
WITH {_CRC_TABLE},
texts AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS r, coalesce({_RUNS}, []) AS words FROM documents
  UNION ALL SELECT 1, NULL, -row_number() OVER (), coalesce({_RUNS}, []) FROM benchmark),
runs AS (
  SELECT side, r, unnest(list_concat(words, list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]))) AS run FROM texts),
hashed AS (SELECT run, {_crc_sql("hex(encode(run))")} % 10000 AS bucket FROM (SELECT DISTINCT run FROM runs), crcs),
features AS (SELECT side, r, bucket FROM runs JOIN hashed USING (run)),
counted AS (SELECT bucket, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS t FROM features GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000)))) AS BIGINT) AS gain FROM counted),
weights AS (SELECT r, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM features JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, r, len(words) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM texts LEFT JOIN weights USING (r) WHERE side = 0),
final AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score, r FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS place, count(*) OVER () AS n FROM final WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM final LEFT JOIN ranked USING (r)"""

ORACLES: dict[str, str] = {"op2_sharding": SHARDING_SQL, "op4_quality_rules": RULES_SQL, "op13_importance": IMPORTANCE_SQL}
