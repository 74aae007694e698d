"""The pipeline's mixing reaches its targets and leaves clean documents their weight."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from limnos.llm import mixing, shared
from limnos.sources.driver_tables import table

TABLES = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(TABLES).exists(), reason="test tables are not here")
def test_targets_are_reached_and_clean_documents_stay(spark):
    docs, labels = table(spark, TABLES, "documents"), table(spark, TABLES, "labels")
    rows = corpus_pipeline.apply_rules(spark, corpus_pipeline.drop_toxic(spark, docs, TABLES), TABLES)
    domains = sorted(corpus_pipeline.WEIGHTS)
    model = mixing.train(docs, labels, mixing.domain_of())
    found = shared.staged(mixing.domain_posteriors(rows, model, domains, {"doc_id": "doc_id"}))
    fit = mixing.fit_rates(found, domains, corpus_pipeline.WEIGHTS)
    assert max(abs(a - b) for a, b in zip(fit.reached, fit.targets)) <= mixing.TOLERANCE
    clean = labels.where(mixing.domain_of() == mixing.CLEAN).where(shared.held_out(F.col("doc_id"))).select("doc_id")
    rate = mixing.rate_column(F.col("posteriors"), fit.steps)
    lowest, middle = found.join(clean, "doc_id").agg(F.min(rate), F.avg(rate)).first()
    assert lowest > 0.9 and abs(middle - 1) < 0.05
