"""Corpus pipeline: documents to training tokens, each stage written as a table and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limnos.llm import bpe, mixing, quality_rules, simhash, toxicity
from limnos.session import staged
from limnos.sources.driver_tables import table

#: Shares of the expected tokens after mixing. The toxic share is small but not zero: posteriors are soft, and a share of exactly zero
#: would take the rate of every document with a trace of it down to zero, clean ones included.
WEIGHTS = {mixing.CLEAN: 0.97, mixing.POOR: 0.025, mixing.TOXIC: 0.005}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier does not reject."""
    return toxicity.keep_civil(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents no quality rule rejects."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by SimHash (shingles of 3 words, at most 2 differing bits)."""
    return simhash.one_per_group(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    model = mixing.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mixing.domain_of())
    return mixing.mix(docs, model, WEIGHTS, not_raised=[mixing.TOXIC])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return bpe.encode_texts(docs, {"doc_id": "doc_id", "lang": "lang", "source": "source"})


STAGES = [("toxicity", drop_toxic), ("quality rules", apply_rules), ("near duplicates", drop_near_duplicates), ("mixing", mix_domains), ("encoding", encode)]

#: No stage but the rules can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        rows = staged(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
