"""2.12 Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.catalog import sql_text
from limnos.catalog.registry import aggregated, meas, merged, query
from limnos.functions.nulls import col
from limnos.operators import chart_data as op
from limnos.operators.time_traces import trace_rows
from limnos.sources.driver_tables import table


def _equal_width(rows: str, bins: int) -> str:
    return f"""
WITH v AS ({rows}), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins}.0e0 AS w FROM v),
c AS (SELECT g, CAST(least(floor((v - lo) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM v, e GROUP BY ALL)
SELECT a.g AS wb_code, CAST(b.i AS INTEGER) AS bin, R(lo + b.i * w) AS bin_start, R(lo + (b.i + 1) * w) AS bin_end, coalesce(n, 0) AS n
FROM (SELECT DISTINCT g FROM v) a CROSS JOIN range({bins}) b(i) CROSS JOIN e LEFT JOIN c ON c.g = a.g AND c.bin = b.i"""


@query("histogram_equal_width", _equal_width("SELECT wb_code AS g, value AS v FROM m WHERE value IS NOT NULL", 40))
def histogram_equal_width(spark, folder):
    return op.histogram_equal_width(meas(spark, folder), "value", 40, ["wb_code"])


@query("histogram_dates", _equal_width(
    "SELECT wb_code AS g, CAST(date_diff('day', DATE '1970-01-01', sampled_on) AS DOUBLE) AS v FROM m", 24))
def histogram_dates(spark, folder):
    return op.histogram_equal_width(meas(spark, folder), "sampled_on", 24, ["wb_code"])


@query("histogram_edges", """
SELECT wb_code, CAST(least(floor(value / 105000.0e0), 99) AS INTEGER) AS bin, count(*) AS n,
  R(least(floor(value / 105000.0e0), 99) * 105000.0e0) AS bin_start
FROM m WHERE target = 'PROMO' AND value BETWEEN 0 AND 10500000 GROUP BY ALL""")
def histogram_edges(spark, folder):
    return op.histogram_edges(meas(spark, folder).where("target = 'PROMO'"), "value", 0, 10_500_000, 100, ["wb_code"])


@query("histogram_binwidth", """
SELECT event_type, R(floor(value / 5.0e0 + 0.5e0) * 5.0e0) AS bin_centre, count(*) AS n
FROM events WHERE value BETWEEN 0 AND 200 GROUP BY ALL""")
def histogram_binwidth(spark, folder):
    return op.histogram_binwidth(table(spark, folder, "events"), "value", 5, ["event_type"], 0, 200)


@query("boxplot_stats", """
WITH q AS (SELECT target, wb_code, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM me GROUP BY ALL)
SELECT q.target, q.wb_code, R(q1) AS q1, R(median) AS median, R(q3) AS q3,
  R(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS whisker_low,
  R(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS whisker_high,
  count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers, count(*) AS n
FROM me JOIN q USING (target, wb_code) GROUP BY q.target, q.wb_code, q1, median, q3""")
def boxplot_stats(spark, folder):
    return op.boxplot_stats(merged(spark, folder), ["target", "wb_code"], "value")


@query("boxplot_events", """
WITH v AS (SELECT event_type, round(value * 100) AS cents FROM events),
q AS (SELECT event_type, quantile_cont(cents, 0.25) AS q1, quantile_cont(cents, 0.5) AS median, quantile_cont(cents, 0.75) AS q3 FROM v GROUP BY ALL)
SELECT q.event_type, R(q1) AS q1, R(median) AS median, R(q3) AS q3,
  R(min(cents) FILTER (cents BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS whisker_low,
  R(max(cents) FILTER (cents BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS whisker_high,
  count(*) FILTER (cents NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers, count(*) AS n
FROM v JOIN q USING (event_type) GROUP BY q.event_type, q1, median, q3""")
def boxplot_events(spark, folder):
    events = table(spark, folder, "events").withColumn("cents", F.round(col("value") * 100))
    return op.boxplot_stats(events, ["event_type"], "cents")


@query("density_curve", """
WITH v AS (SELECT wb_code, value / 1000000.0e0 AS v FROM m WHERE value IS NOT NULL),
e AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 512.0e0 AS w FROM v),
s AS (SELECT wb_code, count(*) AS n, 0.9e0 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34e0)
  * power(count(*), -0.2e0) AS bw FROM v GROUP BY wb_code),
b AS (SELECT wb_code, least(floor((v - lo) / w), 511) AS bin, count(*) AS c, sum((v - lo) / w - least(floor((v - lo) / w), 511)) AS up FROM v, e GROUP BY ALL),
g AS (SELECT i AS point, lo + i * (hi - lo) / 127.0e0 AS x FROM e, range(128) t(i))
SELECT b.wb_code, CAST(point AS INTEGER) AS point, R(x) AS x, R(bw) AS bandwidth,
  R(sum((c - up) * exp(-power((x - lo - bin * w) / bw, 2) / 2) + up * exp(-power((x - lo - (bin + 1) * w) / bw, 2) / 2)) / (n * bw * sqrt(2 * pi()))) AS density
FROM b JOIN s USING (wb_code), g, e GROUP BY b.wb_code, point, x, bw, n""", digits=6)
def density_curve(spark, folder):
    rows = meas(spark, folder).withColumn("value", col("value") / 1000000.0)
    return op.density_curve(rows, "value", ["wb_code"])


@query("qq_normal", f"""
WITH o AS (SELECT target, value, row_number() OVER (PARTITION BY target ORDER BY value, sample_id) AS position,
  count(*) OVER (PARTITION BY target) AS n FROM m WHERE value IS NOT NULL),
q AS (SELECT target, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM o GROUP BY target),
z AS (SELECT *, position / CAST(n + 1 AS DOUBLE) AS p FROM o),
t AS (SELECT *, {sql_text.normal_quantile('p')} AS theoretical FROM z)
SELECT target, position, R(theoretical) AS theoretical, value AS sample,
  R((q1 + q3) / 2 + (q3 - q1) / (2 * {sql_text.normal_quantile('0.75e0')}) * theoretical) AS line FROM t JOIN q USING (target)""",
       digits=3)
def qq_normal(spark, folder):
    return op.qq_normal(meas(spark, folder), "value", ["target"], "sample_id")


@query("qq_two_sample", f"""
WITH o AS (SELECT wb_code, value, sample_id, row_number() OVER (PARTITION BY wb_code ORDER BY value, sample_id) AS position
  FROM m WHERE value IS NOT NULL),
u AS (SELECT wb_code, sample_id, {sql_text.uniform(7, 'sample_id')} AS u FROM o),
z AS (SELECT *, {sql_text.normal_quantile('u')} AS z FROM u),
s AS (SELECT wb_code, z, row_number() OVER (PARTITION BY wb_code ORDER BY z, sample_id) AS position FROM z),
k AS (SELECT wb_code, avg(value) AS mean, stddev_samp(value) AS sd FROM o GROUP BY wb_code)
SELECT wb_code, position, value AS observed, R(mean + sd * z) AS simulated
FROM o JOIN s USING (wb_code, position) JOIN k USING (wb_code)""", digits=2)
def qq_two_sample(spark, folder):
    return op.qq_two_sample(meas(spark, folder), "value", ["wb_code"], "sample_id", seed=7)


@query("time_trace_panel", """
SELECT site_id, CAST(sampled_on AS VARCHAR) AS sampled_on, value, depth, uom,
  'STANDARD [' || uom || '] at ' || CAST(site_id AS VARCHAR) AS panel FROM me
WHERE target = 'STANDARD' AND (site_id, year) IN (SELECT (site_id, year) FROM ay WHERE target = 'STANDARD' AND n > 10 AND below_loq_pct < 30)""")
def time_trace_panel(spark, folder):
    agg = aggregated(spark, folder, "site_id", "target", "year").where("target = 'STANDARD'")
    panel = op.time_trace_panel(merged(spark, folder), trace_rows(agg, ["site_id", "year"], 30, 10, 1), "STANDARD")
    return panel.withColumn("sampled_on", col("sampled_on").cast("string"))
