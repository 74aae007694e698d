"""Ranks of many rows: no row is compared with every cut point, no draw is computed more than once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from limnos.functions.ranks import positions, ranked_values
from limnos.operators import chart_data as op


def test_rows_are_not_compared_with_a_list_of_cuts(spark):
    draw = random.Random(2)
    df = spark.createDataFrame([(i % 3, draw.random(), i) for i in range(3000)] + [(None, 0.5, 3000)], "g int, v double, id long")
    for ranked in (positions(df, ["g"], ["v", "id"], sample_every=50), ranked_values(df, ["g"], "v", sample_every=50)):
        assert "lambda" not in ranked._jdf.queryExecution().toString()
        assert ranked.count() == 3000 and ranked.select("n_group").distinct().collect()[0][0] == 1000
    best = positions(df, ["g"], ["v", "id"], sample_every=50).where("position = 1000").select("g", "v").collect()
    assert {r.g: r.v for r in best} == {r.g: r.m for r in df.where("g IS NOT NULL").groupBy("g").agg(F.max("v").alias("m")).collect()}


def test_simulated_draws_are_written_once(spark):
    df = spark.createDataFrame([(i % 2, float(i), i) for i in range(200)], "g int, v double, id long")
    plan = op.qq_two_sample(df, "v", ["g"], "id")._jdf.queryExecution().toString()
    assert "md5" not in plan
