"""Null and number semantics, one test per rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from limnos.functions import nulls
from limnos.operators import aggregates as ag
from limnos.operators import columns as co
from limnos.operators import filters as fi
from limnos.operators import joins as jo
from limnos.operators import reshape as re
from limnos.sources import readers


@pytest.fixture(scope="module")
def meas(spark):
    return spark.createDataFrame(
        [(1, "N", 1.0, False), (1, "N", 3.0, True), (1, "P", None, True), (2, "N", 5.0, False), (None, "N", 9.0, False),
         (2, None, 4.0, None)],
        "site_id long, target string, value double, below_loq boolean")


def test_grouping_drops_null_keys(meas, rows):
    got = rows(ag.aggregate_stats(meas, ["site_id", "target"]).select("site_id", "target", "n", "mean", "below_loq_sum", "below_loq_pct"))
    assert got == [(1, "N", 2, 2.0, 1, 50.0), (1, "P", 0, None, 1, None), (2, "N", 1, 5.0, 0, 0.0)]


def test_group_size_keeps_null_keys(meas, rows):
    assert (None, 1) in rows(ag.group_size(meas, ["site_id"]))


def test_value_counts_null(meas, rows):
    assert rows(ag.value_counts(meas, "target")) == [("N", 4), ("P", 1)]
    assert (None, 1) in rows(ag.value_counts(meas, "target", keep_null=True))


def test_sd_of_one_row_is_null(meas):
    assert ag.aggregate_stats(meas, ["site_id", "target"]).where("site_id = 2").first().sd is None


def test_mean_propagates_missing(meas, rows):
    got = rows(ag.mean_na_propagating(meas.where("target is not null and site_id is not null"), ["target"]).select("target", "avg"))
    assert got == [("N", 3.0), ("P", 0.0)]
    kept = ag.mean_na_propagating(meas, ["target"], fill=None).where("target = 'P'").first()
    assert kept.avg is None


def test_distinct_counts_null_as_value(meas, rows):
    assert rows(ag.count_distinct_with_null(meas, "target", "site_id")) == [("N", 3), ("P", 1), (None, 1)]
    assert rows(ag.count_distinct_by(meas, "target", "site_id")) == [("N", 2), ("P", 1)]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (40.0,)], "x double").select(nulls.nan_to_null(F.col("x")).alias("x"))
    assert df.where("x > 30").count() == 1


def test_zero_denominator_is_null(spark):
    assert spark.range(1).select(nulls.ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None


def test_bad_numbers_become_null(spark):
    df = spark.createDataFrame([("1", "GW", "N", None, "n.d.", "u", "maybe")],
                               "site_id string, wb_code string, target string, sampled_on date, value string, uom string, below_loq string")
    r = co.transmute_measurements(df).first()
    assert r.measured_value is None and r.below_LOQ is None and r.meas_year is None


def test_extract_without_match_is_null(spark):
    df = spark.createDataFrame([("CH12a", "GW", "W"), ("CH", "GW", "W"), ("CH7", "RW", None)], "site string, wb string, s string")
    got = [r.obs_id for r in co.observation_key(df, "site", "wb", "s").collect()]
    assert got == ["W-G-12a", None, None]


def test_count_pivot_tells_absent_from_null(spark, rows):
    df = spark.createDataFrame([(1, "N", None), (1, "P", 2.0), (2, "P", 3.0)], "site_id long, target string, n double")
    assert rows(re.count_matrix(df, ["N", "P"])) == [(1, 0, 1), (2, None, 1)]


def test_fill_absent_keeps_present_null(spark, rows):
    df = spark.createDataFrame([(1, "N", None), (1, "P", 2.0), (2, "P", 3.0)], "site_id long, target string, sd double")
    assert rows(re.pivot_fill_absent(df, ["site_id"], ["sd"], ["N", "P"])) == [(1, None, 2.0), (2, 0.0, 3.0)]


def test_missing_month(spark):
    df = spark.createDataFrame([(None,)], "d date")
    assert co.derive_period(df, "d").first().season is None
    assert co.derive_period(df, "d", missing_is_summer=True).first().season == "summer"


def test_false_or_null(spark):
    df = spark.createDataFrame([(1, None, False), (2, True, None), (3, False, False)], "i long, a boolean, b boolean")
    assert [r.i for r in fi.filter_false_or_null(df, ["a", "b"]).orderBy("i").collect()] == [1, 3]


def test_normalise_missing(spark, rows):
    df = spark.createDataFrame([("NA", 1), (" ", 2), ("N/A", 3), ("", 4), ("x", 5), (None, 6)], "t string, i int")
    assert rows(readers.normalise_missing(df)) == [("x", 5), (None, 1), (None, 2), (None, 3), (None, 4), (None, 6)]


def test_top_k_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1), ("c", 2)], "target string, site_id int")
    assert [r.target for r in ag.top_k(df, 2).collect()] == ["c", "a"]


def test_first_per_key_has_a_stated_order(spark, rows):
    df = spark.createDataFrame([(1, 2.0, "x"), (1, 1.0, "z"), (1, 1.0, "y"), (2, None, "w"), (2, 5.0, "v")], "k long, o double, t string")
    assert rows(jo.first_per_key(df, ["k"], ["o"])) == [(1, 1.0, "y"), (2, 5.0, "v")]
    assert rows(jo.first_per_key(df, ["k"], ["o"], ["o"])) == [(1, 2.0, "x"), (2, 5.0, "v")]


def test_grouped_mutate_keeps_the_null_group(meas, rows):
    got = rows(ag.grouped_mutate(meas, ["site_id"]).select("site_id", "value", "group_mean"))
    assert len(got) == 6 and (None, 9.0, 9.0) in got and (2, 5.0, 4.5) in got
