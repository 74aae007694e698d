"""2.5 to 2.7 Aggregations, group statistics on rows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.catalog.registry import aggregated, meas, merged, query, sites, stats_columns
from limnos.functions.nulls import col
from limnos.operators import aggregates as op
from limnos.operators.columns import derive_period
from limnos.operators.joins import enrich_sites, priority_dedupe_sites
from limnos.sources.driver_tables import table


def _dated(spark, folder):
    return derive_period(meas(spark, folder), "sampled_on")


def _group_stats(*groups):
    def run(spark, folder):
        return op.aggregate_stats(merged(spark, folder), groups)
    return run


query("aggregate_stats", f"SELECT {stats_columns('site_id', 'target', 'year')} FROM ay")(
    _group_stats("site_id", "target", "year"))
query("aggregate_stats_site", f"SELECT {stats_columns('site_id', 'target')} FROM ag")(_group_stats("site_id", "target"))
query("aggregate_stats_season", f"SELECT {stats_columns('site_id', 'target', 'season')} FROM ase")(
    _group_stats("site_id", "target", "season"))
query("aggregate_stats_site_wb", f"SELECT {stats_columns('site_id', 'wb_code', 'target')} FROM asw")(
    _group_stats("site_id", "wb_code", "target"))
query("aggregate_stats_wb", f"SELECT {stats_columns('wb_code', 'target')} FROM aw")(_group_stats("wb_code", "target"))


@query("aggregate_rollup", f"SELECT {stats_columns('wb_code', 'target')} FROM aw", digits=3)
def aggregate_rollup(spark, folder):
    finest = op.aggregate_moments(merged(spark, folder), ["site_id", "wb_code", "target", "year"])
    return op.roll_up_stats(finest, ["wb_code", "target"])


@query("value_counts", "SELECT status, count(*) AS n FROM m GROUP BY status")
def value_counts(spark, folder):
    return op.value_counts(meas(spark, folder), "status", keep_null=True)


@query("value_counts_known", "SELECT status, count(*) AS n FROM m WHERE status IS NOT NULL GROUP BY status")
def value_counts_known(spark, folder):
    return op.value_counts(meas(spark, folder), "status")


@query("group_size", "SELECT below_loq, status, uom, count(*) AS n FROM m GROUP BY ALL")
def group_size(spark, folder):
    return op.group_size(meas(spark, folder), ["below_loq", "status", "uom"])


@query("recap_stats", """
SELECT target, R(min(value)) AS min, R(max(value)) AS max, R(avg(value)) AS mean, R(stddev_samp(value)) AS sd, count(*) AS n
FROM m WHERE NOT below_loq GROUP BY target""")
def recap_stats(spark, folder):
    return op.recap_stats(meas(spark, folder), ["target"])


@query("recap_sampling", """
SELECT target, country, season, count(DISTINCT site_id) AS n_sites, CAST(sum(n) AS BIGINT) AS n_measurements,
  min(n) AS min_measurements, max(n) AS max_measurements, R(quantile_cont(n, 0.5)) AS med_measurements
FROM ase JOIN sd USING (site_id) GROUP BY ALL""")
def recap_sampling(spark, folder):
    agg = aggregated(spark, folder, "site_id", "target", "season")
    known = priority_dedupe_sites(sites(spark, folder)).select("site_id", "country")
    return op.recap_sampling(agg.join(known, "site_id"), ["target", "country", "season"])


@query("recap_country_year", """
SELECT country, year, target, R(avg(mean)) AS mean_of_means, R(stddev_samp(mean)) AS sd_of_means,
  CAST(sum(n) AS BIGINT) AS n_samples, CAST(sum(below_loq_sum) AS BIGINT) AS n_below_loq
FROM ay JOIN sd USING (site_id) GROUP BY ALL""")
def recap_country_year(spark, folder):
    agg = aggregated(spark, folder, "site_id", "target", "year")
    return op.recap_country_year(agg.join(priority_dedupe_sites(sites(spark, folder)).select("site_id", "country"), "site_id"))


@query("site_target_profile", """
SELECT site_id, target, R(median(value)) AS median, R(avg(value)) AS mean, R(stddev_samp(value)) AS sd, R(min(value)) AS min,
  R(max(value)) AS max, count(DISTINCT value) AS n_distinct, count(value) AS n FROM m WHERE value IS NOT NULL GROUP BY ALL""")
def site_target_profile(spark, folder):
    return op.site_target_profile(meas(spark, folder))


@query("count_distinct_by", "SELECT target, count(DISTINCT site_id) AS n_distinct FROM m GROUP BY target")
def count_distinct_by(spark, folder):
    return op.count_distinct_by(meas(spark, folder), "target", "site_id")


@query("count_distinct_with_null", """
SELECT site_id, count(DISTINCT depth) + max(CASE WHEN depth IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM m GROUP BY site_id""")
def count_distinct_with_null(spark, folder):
    return op.count_distinct_with_null(meas(spark, folder), "site_id", "depth")


@query("collect_values", "SELECT target, string_agg(DISTINCT uom, ';' ORDER BY uom) AS values FROM m GROUP BY target")
def collect_values(spark, folder):
    return op.collect_values(meas(spark, folder), "target", "uom").withColumn("values", F.array_join("values", ";"))


@query("multi_unit_targets", """
SELECT target, string_agg(DISTINCT uom, ';' ORDER BY uom) AS units, CAST(count(DISTINCT uom) AS INTEGER) AS n_units
FROM m GROUP BY target HAVING count(DISTINCT uom) > 1""")
def multi_unit_targets(spark, folder):
    return op.multi_unit_targets(meas(spark, folder)).withColumn("units", F.array_join("units", ";"))


@query("dataset_summary", """
SELECT count(DISTINCT site_id) AS n_site_id, count(DISTINCT wb_code) AS n_wb_code, count(DISTINCT rbd) AS n_rbd,
  count(DISTINCT target) AS n_target, count(DISTINCT uom) AS n_uom, CAST(min(sampled_on) AS VARCHAR) AS first_date,
  CAST(max(sampled_on) AS VARCHAR) AS last_date FROM m LEFT JOIN (SELECT site_id, rbd FROM sd) USING (site_id)""")
def dataset_summary(spark, folder):
    df = enrich_sites(meas(spark, folder), priority_dedupe_sites(sites(spark, folder)).select("site_id", "rbd"))
    out = op.dataset_summary(df, ["site_id", "wb_code", "rbd", "target", "uom"], "sampled_on")
    return out.withColumn("first_date", col("first_date").cast("string")).withColumn("last_date", col("last_date").cast("string"))


@query("missing_rate", """
SELECT count(*) AS n_rows, count(*) - count(value) AS n_missing, count(*) FILTER (below_loq) AS n_below_loq,
  R((count(*) - count(value)) * CAST(100 AS DOUBLE) / count(*)) AS missing_pct,
  R(count(*) FILTER (below_loq) * CAST(100 AS DOUBLE) / count(*)) AS below_loq_pct FROM m""")
def missing_rate(spark, folder):
    return op.missing_rate(meas(spark, folder))


@query("data_completeness", """
SELECT target, season, count(*) AS total_values, count(*) - count(value) AS missing_values,
  count(*) FILTER (below_loq) AS not_measured_values, count(DISTINCT site_id) AS number_of_sites,
  count(DISTINCT year) AS number_of_years,
  R((count(*) - count(value)) * CAST(100 AS DOUBLE) / count(*)) AS missing_perc,
  R(count(*) FILTER (below_loq) * CAST(100 AS DOUBLE) / count(*)) AS not_measured_perc,
  R(CAST(count(*) AS DOUBLE) / count(DISTINCT site_id)) AS avg_meas_per_site,
  R(count(DISTINCT site_id) * CAST(100 AS DOUBLE) / (SELECT count(DISTINCT site_id) FROM m)) AS meas_site_ratio
FROM mp GROUP BY target, season""")
def data_completeness(spark, folder):
    return op.data_completeness(_dated(spark, folder))


@query("mean_na_propagating", """
SELECT site_id, target, year, R(coalesce(CASE WHEN count(*) = count(value) THEN avg(value) END, 0)) AS avg,
  R(coalesce(CASE WHEN count(*) = count(value) THEN stddev_samp(value) END, 0)) AS sd FROM mp GROUP BY ALL""")
def mean_na_propagating(spark, folder):
    return op.mean_na_propagating(_dated(spark, folder), ["site_id", "target", "year"])


@query("common_to_all_groups", """
WITH p AS (SELECT DISTINCT target, season, country FROM me)
SELECT country, count(*) AS n_groups FROM p GROUP BY country
HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT target, season FROM p))""")
def common_to_all_groups(spark, folder):
    return op.common_to_all_groups(merged(spark, folder), ["target", "season"], "country")


@query("column_means", """
SELECT R(avg(lon)) AS lon, R(avg(lat)) AS lat, R(median(lon)) AS median_lon, R(median(lat)) AS median_lat FROM sd""")
def column_means(spark, folder):
    s = priority_dedupe_sites(sites(spark, folder))
    middle = op.column_means(s, ["lon", "lat"], median=True).select(F.struct("lon", "lat")).scalar()
    return (op.column_means(s, ["lon", "lat"]).withColumn("median_lon", middle.getField("lon"))
            .withColumn("median_lat", middle.getField("lat")))


@query("tukey_five_numbers", """
WITH o AS (SELECT target, value, row_number() OVER (PARTITION BY target ORDER BY value) AS i, count(*) OVER (PARTITION BY target) AS n
  FROM m WHERE value IS NOT NULL),
d AS (SELECT *, floor((n + 3) / 2) / 2 AS d4, CAST(n + 1 AS DOUBLE) / 2 AS h FROM o)
SELECT target, R(min(value)) AS min,
  R((max(value) FILTER (i = floor(d4)) + max(value) FILTER (i = ceil(d4))) / 2) AS lower_hinge,
  R((max(value) FILTER (i = floor(h)) + max(value) FILTER (i = ceil(h))) / 2) AS median,
  R((max(value) FILTER (i = floor(n + 1 - d4)) + max(value) FILTER (i = ceil(n + 1 - d4))) / 2) AS upper_hinge,
  R(max(value)) AS max, max(n) AS n FROM d GROUP BY target""")
def tukey_five_numbers(spark, folder):
    return op.tukey_five_numbers(meas(spark, folder), ["target"], "value")


@query("grouped_mutate", """
SELECT sample_id, value, R(avg(value) OVER w) AS group_mean, R(stddev_samp(value) OVER w) AS group_sd, count(value) OVER w AS group_n
FROM m WINDOW w AS (PARTITION BY site_id, target)""")
def grouped_mutate(spark, folder):
    return op.grouped_mutate(meas(spark, folder), ["site_id", "target"]).select(
        "sample_id", "value", "group_mean", "group_sd", "group_n")


@query("busiest_site_series", """
SELECT m.site_id, CAST(sampled_on AS VARCHAR) AS sampled_on, value, site_name FROM m LEFT JOIN sd ON m.site_id = sd.site_id
WHERE target = 'PROMO' AND m.site_id = (SELECT site_id FROM m WHERE target = 'PROMO' GROUP BY site_id ORDER BY count(*) DESC, site_id LIMIT 1)""")
def busiest_site_series(spark, folder):
    names = priority_dedupe_sites(sites(spark, folder)).select("site_id", "site_name")
    series = op.busiest_site_series(enrich_sites(meas(spark, folder), names), "PROMO", ["sampled_on", "value", "site_name"])
    return series.withColumn("sampled_on", col("sampled_on").cast("string"))


@query("sort_mixed", f"SELECT {stats_columns('site_id', 'target')} FROM ag ORDER BY n DESC NULLS LAST, sd DESC NULLS LAST, target, site_id")
def sort_mixed(spark, folder):
    return op.sort_mixed(aggregated(spark, folder, "site_id", "target"), ["n", "sd"], ["target", "site_id"])


@query("top_k_targets", """
SELECT site_id, target, value FROM m WHERE target IN (SELECT target FROM m GROUP BY target ORDER BY count(*) DESC, target LIMIT 3)""")
def top_k_targets(spark, folder):
    return op.top_k_targets(meas(spark, folder).select("site_id", "target", "value"), 3)


@query("top_k_targets_by_site", """
SELECT site_id, p_brand, value FROM (SELECT l_suppkey AS site_id, p_brand, l_extendedprice AS value FROM lineitem JOIN part ON l_partkey = p_partkey)
WHERE p_brand IN (SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand
  ORDER BY count(DISTINCT l_suppkey) DESC, p_brand LIMIT 10)""")
def top_k_targets_by_site(spark, folder):
    part = table(spark, folder, "part").select(col("p_partkey").alias("l_partkey"), "p_brand")
    rows = table(spark, folder, "lineitem").join(part, "l_partkey").select(
        col("l_suppkey").alias("site_id"), "p_brand", col("l_extendedprice").alias("value"))
    return op.top_k_targets(rows, 10, "p_brand", distinct="site_id")


@query("frequent_targets", """
SELECT site_id, target, value FROM m WHERE NOT below_loq AND target IN (
  SELECT target FROM m WHERE NOT below_loq GROUP BY target HAVING count(*) > (SELECT count(*) FROM m) / 7)""")
def frequent_targets(spark, folder):
    m = meas(spark, folder)
    return op.frequent_targets(m, m.count() / 7).select("site_id", "target", "value")


@query("counts_by_year", "SELECT year, count(*) AS n FROM mp GROUP BY year")
def counts_by_year(spark, folder):
    return op.counts_by_year(_dated(spark, folder))


@query("crosstab", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
  count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority""")
def crosstab(spark, folder):
    return op.crosstab(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("trend_line", """
SELECT target, year, R(regr_slope(value, month)) AS slope, R(regr_intercept(value, month)) AS intercept,
  count(value) AS n FROM mp WHERE value IS NOT NULL GROUP BY target, year""", digits=3)
def trend_line(spark, folder):
    return op.trend_line(_dated(spark, folder), ["target", "year"], "month", "value")
