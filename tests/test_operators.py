"""Small hand-made frames for columns, joins, reshaping, charts and traces."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from limnos.operators import aggregates as ag
from limnos.operators import chart_data as ch
from limnos.operators import columns as co
from limnos.operators import filters as fi
from limnos.operators import joins as jo
from limnos.operators import quality
from limnos.operators import reshape as rs
from limnos.operators import time_traces as tt
from limnos.plans import europe, seasons, swiss
from limnos.session import shared_folder
from limnos.sources import readers, staging


@pytest.mark.parametrize("name, clean", [
    ("monitoringSiteIdentifier", "monitoring_site_identifier"), ("resultObservedValue_mean_pH", "result_observed_value_mean_ph"),
    ("belowLOQ", "below_loq"), ("Dissolved oxygen", "dissolved_oxygen"), ("p_h", "ph"), ("a.b (c)", "a_b_c")])
def test_clean_name(name, clean):
    assert co.clean_name(name) == clean


def test_clean_names_stay_unique(spark):
    assert co.clean_names(spark.createDataFrame([(1, 2, 3)], ["a b", "a.b", "aB"])).columns == ["a_b", "a_b_2", "a_b_3"]


def test_columns_by_name_position_and_pattern(spark):
    df = spark.createDataFrame([(1, None, 3)], "site int, lipid int, `Lead and its compounds` int")
    assert co.project_columns(df, [2, "site"]).columns == ["Lead and its compounds", "site"]
    assert co.drop_empty_columns(df).columns == ["site", "Lead and its compounds"]
    assert co.drop_columns_matching(df, "^((?!compounds|Other).)*$", keep=True).columns == ["site", "lipid"]
    assert co.select_prefix(df, ["li"], keep=False, always=["site"]).columns == ["site", "Lead and its compounds"]


def test_swiss_coordinates_of_bern(spark):
    df = spark.createDataFrame([(7.438632, 46.951083)], "lon double, lat double")
    r = co.wgs84_to_lv95(df, "lon", "lat").first()
    assert r.east == pytest.approx(2_600_000, abs=3) and r.north == pytest.approx(1_200_000, abs=3)
    old = co.lv03_shift(co.wgs84_to_lv95(df, "lon", "lat")).first()
    assert old.east == pytest.approx(600_000, abs=3) and old.north == pytest.approx(200_000, abs=3)


def test_shares_of_an_empty_row_are_null(spark):
    df = spark.createDataFrame([(1, 3, 1, 2), (2, None, 0, 0)], "id int, a int, b int, below int")
    one, two = co.row_totals_and_shares(df, ["a", "b"], ["below"]).orderBy("id").collect()
    assert (one.total, one.a_share, one.below_loq_ratio) == (4, 0.75, 0.5)
    assert (two.total, two.a_share) == (0, None)


@pytest.mark.parametrize("length", [0, 2, 2000])
def test_lists_of_any_length_take_the_type_of_the_column(spark, length):
    df = spark.createDataFrame([("a", 7), ("1", 1), (None, None)], "target string, n int")
    listed = [*range(1, length + 1)]
    assert [r.target for r in fi.filter_in_list(df, "target", listed).collect()] == ["1"] * bool(length)
    assert [r.n for r in fi.filter_in_list(df, "n", ["x", None, *map(str, listed[:1])]).collect()] == [1] * bool(length)


def test_priority_dedupe(spark, rows):
    df = spark.createDataFrame([(1, "euMonitoringSiteCode", "A"), (1, "eionetMonitoringSiteCode", "B"), (1, None, "C"),
                                (None, "euMonitoringSiteCode", "D"), (2, "eionetMonitoringSiteCode", "E")],
                               "site_id int, scheme string, country string")
    assert rows(jo.priority_dedupe_sites(df)) == [(1, "euMonitoringSiteCode", "A"), (2, "eionetMonitoringSiteCode", "E")]


def test_ambiguous_keys(spark, rows):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "b", 1.0), (None, "c", 1.0), (None, "c", 1.0)], "k int, t string, depth double")
    assert rows(jo.drop_ambiguous_keys(df, ["k"])) == [(2, "b", 1.0)]
    assert rows(jo.drop_ambiguous_keys(df, ["k", "t"], F.count_distinct("depth"))) == [(2, "b", 1.0), (None, "c", 1.0), (None, "c", 1.0)]


def test_integrity_check(spark):
    meas = spark.createDataFrame([(1,), (1,), (2,), (None,)], "site_id int")
    sites = spark.createDataFrame([(1,), (1,), (3,), (None,)], "site_id int")
    r = jo.integrity_check(meas, sites).first()
    assert (r.sites_used, r.sites_matched, r.matched_pct, r.all_matched) == (2, 1, 50.0, False)
    assert (r.null_sites_in_data, r.null_sites_in_metadata, r.repeated_sites_in_metadata) == (1, 1, 1)


def test_rollup_equals_direct(spark):
    df = spark.createDataFrame([(i % 3, i % 7, 1e9 + i * 0.5, i % 2 == 0) for i in range(200)], "g int, y int, value double, below_loq boolean")
    direct = {r.g: r for r in ag.aggregate_stats(df, ["g"]).collect()}
    for r in ag.roll_up_stats(ag.aggregate_moments(df, ["g", "y"]), ["g"]).collect():
        d = direct[r.g]
        assert (r.n, r.below_loq_sum, r.below_loq_pct) == (d.n, d.below_loq_sum, d.below_loq_pct)
        assert r["mean"] == pytest.approx(d["mean"], rel=1e-15) and r.sd == pytest.approx(d.sd, rel=1e-9)


def test_hinges_are_not_quartiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 6)], "g string, v double")
    r = ag.tukey_five_numbers(df, ["g"], "v").first()
    assert tuple(r)[1:6] == (1.0, 2.0, 3.5, 5.0, 6.0)


def test_common_to_all_groups(spark, rows):
    df = spark.createDataFrame([("N", "s", "CH"), ("N", "w", "CH"), ("P", "s", "CH"), ("N", "s", "FR"), ("P", "s", "FR")],
                               "target string, season string, country string")
    assert rows(ag.common_to_all_groups(df, ["target", "season"], "country")) == [("CH", 3)]


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1, 5, None, 2), (2, 6, None, None), (3, None, 1, None)], "id int, a int, b int, c int")
    kept = rs.drop_sparse_columns(df, ["id"], min_filled=2)
    assert kept.columns == ["id", "a"] and kept.count() == 2
    assert rs.drop_sparse_columns(df, ["id"], no_nulls=True).columns == ["id"]
    assert rs.drop_sparse_columns(df, ["id"], min_cell=2).columns == ["id", "a", "c"]
    assert rs.order_columns_by_total(df, ["id"], 2).columns == ["id", "a", "c"]


def test_pivot_values_are_all_sorted_values(spark):
    assert rs.pivot_values(spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "target string")) == ["a", "b"]


def test_histogram_keeps_the_maximum_and_empty_bins(spark, rows):
    df = spark.createDataFrame([(0.0,), (10.0,), (9.9,), (None,)], "v double")
    assert rows(ch.histogram_equal_width(df, "v", 4).select("bin", "n")) == [(0, 1), (1, 0), (2, 0), (3, 2)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert rows(ch.histogram_equal_width(same, "v", 2).select("bin", "n")) == [(0, 2), (1, 0)]
    assert rows(ch.histogram_edges(df, "v", 0, 10, 10).select("bin", "n")) == [(0, 1), (9, 2)]
    assert rows(ch.histogram_binwidth(df, "v", 4)) == [(0.0, 1), (12.0, 1), (8.0, 1)]


def test_boxplot_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 100)], "g string, v double")
    r = ch.boxplot_stats(df, ["g"], "v").first()
    assert (r.median, r.whisker_low, r.whisker_high, r.n_outliers, r.n) == (3.5, 1.0, 5.0, 1, 6)


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([("a", float(i % 50)) for i in range(1000)], "g string, v double")
    points = ch.density_curve(df, "v", ["g"], grid=200).orderBy("point").collect()
    area = sum((a.density + b.density) / 2 * (b.x - a.x) for a, b in zip(points, points[1:]))
    assert 0.85 < area <= 1.0


def test_density_stays_within_its_bound(spark):
    import math
    import random

    draw = random.Random(3)
    values = [draw.gauss(0, 1) for _ in range(400)] + [draw.gauss(6, 0.2) for _ in range(200)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    for bins in (40, 300):
        width = (max(values) - min(values)) / bins
        for p in ch.density_curve(df, "v", ["g"], grid=60, bins=bins).collect():
            h = p.bandwidth
            exact = sum(math.exp(-((p.x - v) / h) ** 2 / 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
            assert abs(p.density - exact) <= width ** 2 / (8 * math.sqrt(2 * math.pi) * h ** 3) + 1e-12


def test_files_with_other_headers(spark, tmp_path):
    """Columns swapped, missing and added in some files of a folder."""
    from limnos.sources.readers import typed_csv

    (tmp_path / "a.csv").write_text("unit,site,value\nmg,S1,1.5\n")
    (tmp_path / "b 1.csv").write_text("value,unit,site,extra\n2.5,ug,S2,x\n")
    (tmp_path / "c.csv").write_text("site,unit\nS3,mg\n")
    (tmp_path / "d.csv").write_text("unit,site,value\n,S4,bad\n")
    columns = {"site": "string", "unit": "string", "value": "double"}
    got = sorted(tuple(r) for r in typed_csv(spark, str(tmp_path), columns).collect())
    assert got == [("S1", "mg", 1.5), ("S2", "ug", 2.5), ("S3", "mg", None), ("S4", None, None)]


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "a")], "x int, t string")
    got = {r["column"]: (r.type, r.n_rows, r.n_null, r.n_distinct) for r in quality.column_profile(df).collect()}
    assert got == {"x": ("int", 3, 0, 2), "t": ("string", 3, 1, 1)}
    loose = {r["column"]: r.n_distinct for r in quality.column_profile(df, approximate=True).collect()}
    assert loose == {"x": 2, "t": 1}


def test_traces_drop_sparse_targets(spark, rows):
    agg = spark.createDataFrame(
        [(s, "N", 400, 5.0) for s in range(12)] + [(s, "P", 400, 5.0) for s in range(3)] + [(0, "Other chemical parameter", 900, 0.0), (1, "S", 900, 80.0)],
        "site_id int, target string, n long, below_loq_pct double")
    year = agg.withColumn("year", F.lit(2000))
    site, site_year = tt.find_time_traces(agg, year, min_site_years=10)
    assert site.columns == ["site_id", "N"] and site.count() == 12
    assert site_year.columns == ["site_id", "year", "N"]


def test_reliable_only(spark):
    agg = spark.createDataFrame([(s, "N", 2000, 200, None, False, None, "A" if s % 2 else "U") for s in range(24)],
                                "site_id int, target string, year int, n long, median_below_loq boolean, max_below_loq boolean, mean_below_loq boolean, status string")
    sites = agg.select("site_id")
    assert tt.find_time_traces_source(agg, sites)[0].count() == 24
    assert tt.find_time_traces_source(agg, sites, reliable_only=True)[0].count() == 12


def test_text_scan(spark, tmp_path, rows):
    path = tmp_path / "m.csv"
    path.write_text("﻿monitoringSiteIdentifier,extra,phenomenonTimeSamplingDate,resultObservedValue,resultQualityObservedValueBelowLOQ\n"
                    "CH1,x,20210305,1.5,True\nNA,x,bad,n.d.,\n", encoding="utf-8")
    df = readers.scan_measurements(spark, str(path))
    assert df.columns == list(readers.MEASUREMENT_COLUMNS)
    got = df.select("monitoringSiteIdentifier", "phenomenonTimeSamplingDate", "resultObservedValue", "resultQualityObservedValueBelowLOQ")
    assert rows(got) == [("CH1", dt.date(2021, 3, 5), 1.5, True), (None, None, None, None)]


def test_second_date_format(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("phenomenonTimeSamplingDate\n05/03/2021 00:00:00\n")
    df = readers.scan_measurements(spark, str(path), "dd/MM/yyyy HH:mm:ss")
    assert df.first().phenomenonTimeSamplingDate == dt.date(2021, 3, 5)


def test_round_trips(spark, rows):
    df = spark.createDataFrame([(1, "a,b", 0.1), (2, None, None)], "i int, t string, v double")
    path = staging.export_csv(df, shared_folder(spark, "csv"))
    assert rows(spark.read.schema(df.schema).csv(path, header=True)) == rows(df)
    assert rows(staging.stage_table(df, shared_folder(spark, "parquet"), ["i"])) == rows(df)


@pytest.fixture(scope="module")
def small(spark):
    """Two targets at eight sites in two countries; site 8 is unknown, one value is missing."""
    data = []
    for s in range(9):
        for t, target in enumerate(("Nitrate", "pH")):
            for month in (2, 7):
                value = None if (s, t, month) == (3, 1, 2) else float(10 * t + s + month)
                data.append((s, ("GW", "RW")[s % 2], target, dt.date(2020, month, 1), value, False))
    meas = spark.createDataFrame(data, "site_id int, wb_code string, target string, sampled_on date, value double, below_loq boolean")
    sites = spark.createDataFrame([(s, f"S{s}", ("CH", "FR")[s // 4], ("Rhine", "Rhone")[s // 4], 7.0, 47.0, "euMonitoringSiteCode") for s in range(8)],
                                  "site_id int, site_name string, country string, rbd string, lon double, lat double, scheme string")
    return meas, sites


def test_europe_merge(small):
    merged = europe.merge_measurements(*small)
    assert merged.count() == 31
    assert {r.wb_code for r in merged.collect()} == {"ground", "river"}
    assert {r.season for r in merged.collect()} == {"winter", "summer"}


def test_water_body_preparation(small):
    merged = europe.merge_measurements(*small)
    ready = europe.prep_water_body(ag.group_stats(merged, ["site_id", "wb_code", "target"]), ag.group_stats(merged, ["wb_code", "target"]), min_samples=1)
    counts = {(r.wb_code, r.split): r["count"] for r in ready.groupBy("wb_code", "split").count().collect()}
    assert counts == {("ground", "train"): 2, ("ground", "test"): 2, ("river", "train"): 2, ("river", "test"): 2}


def test_swiss_features(small):
    ready = swiss.prep_features(swiss.merge_data(*small))
    assert set(ready.columns) == {"site_id", "wb_code", "rbd", "Nitrate", "pH", "split"}
    assert ready.count() == 8 and ready.agg(F.abs(F.avg("pH"))).first()[0] < 1e-9


def test_season_chain(small):
    meas, sites = small
    merged = europe.merge_measurements(meas, sites)
    agg = ag.group_stats(merged, ["site_id", "target", "season"])
    table = seasons.season_table(agg, sites.select("site_id", "lat", "lon", "country", "rbd"))
    assert {r.season for r in table.collect()} == {"W", "S"}
    assert seasons.season_recap(table).count() == 8
    assert seasons.season_matrix(table).count() == 16
    assert seasons.season_matrix(table, fill=None).count() == 15


def test_headers_with_blanks_and_absent_columns(spark, tmp_path):
    from limnos.sources.readers import typed_csv

    (tmp_path / "a.csv").write_text(" site,unit \nS1,mg\n")
    columns = {"unit": "string", "site": "string", "absent": "double"}
    assert [tuple(r) for r in typed_csv(spark, str(tmp_path), columns).collect()] == [("mg", "S1", None)]
    (tmp_path / "b.csv").write_text("unit,site\nug,S2\n")
    assert sorted(tuple(r) for r in typed_csv(spark, str(tmp_path), columns).collect()) == [("mg", "S1", None), ("ug", "S2", None)]
