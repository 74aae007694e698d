"""2.13 Time-trace selection. Thresholds fit the size of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.catalog.registry import TARGETS, aggregated, meas, merged, query, sites
from limnos.functions.nulls import col
from limnos.operators import time_traces as op
from limnos.operators.aggregates import aggregate_moments
from limnos.operators.columns import derive_period


def _source(spark, folder):
    """Pre-aggregated table with the three quality flags, one of them often unknown."""
    below = F.avg(col("below_loq").cast("double"))
    return (derive_period(meas(spark, folder), "sampled_on").groupBy("site_id", "target", "year")
            .agg(F.count("value").alias("n"), (below >= 0.5).alias("median_below_loq"),
                 F.every("below_loq").alias("max_below_loq"),
                 F.when(F.count(F.lit(1)) > 12, below >= 0.4).alias("mean_below_loq")))


_SOURCE = """
WITH g AS (SELECT site_id, target, year, count(value) AS n, avg(CASE WHEN below_loq THEN 1.0e0 ELSE 0.0e0 END) AS b,
  count(*) AS c FROM mp GROUP BY ALL),
f AS (SELECT site_id, target, year, n FROM g WHERE b < 0.5e0 AND (c <= 12 OR b < 0.4e0) AND n > 10
  AND site_id IN (SELECT site_id FROM st WHERE site_id IS NOT NULL)),
k AS (SELECT * FROM f WHERE target IN (SELECT target FROM f GROUP BY target HAVING count(DISTINCT site_id) >= 10))
"""


def _pivot(form: str) -> str:
    return ", ".join(f"{form.format(t=t)} AS \"{t}\"" for t in TARGETS)


_COUNT = "nullif(count(n) FILTER (target = '{t}'), 0)"
_MAX = "max(n) FILTER (target = '{t}')"


@query("find_time_traces_source", f"{_SOURCE} SELECT site_id, {_pivot(_COUNT)} FROM k GROUP BY site_id")
def find_time_traces_source(spark, folder):
    return op.find_time_traces_source(_source(spark, folder), sites(spark, folder), 10, 10, targets=TARGETS)[0]


@query("find_time_traces_source_year", f"{_SOURCE} SELECT site_id, year, {_pivot(_COUNT)} FROM k GROUP BY site_id, year")
def find_time_traces_source_year(spark, folder):
    return op.find_time_traces_source(_source(spark, folder), sites(spark, folder), 10, 10, targets=TARGETS)[1]


def _year_traces(spark, folder, targets=TARGETS):
    """Only the rows of the targets asked for are aggregated."""
    agg = aggregated(spark, folder, "site_id", "target", "year").where(col("target").isin(targets))
    return op.trace_matrix(agg, ["site_id", "year"], 30, 10, 50, targets)


def _rows(view: str, least: int, cells: str, at_least: int) -> str:
    return f"""WITH f AS (SELECT * FROM {view} WHERE below_loq_pct < 30 AND n > {least}),
k AS (SELECT * FROM f WHERE target IN (SELECT target FROM f GROUP BY target HAVING count(DISTINCT {cells}) >= {at_least}))"""


@query("find_time_traces", f"{_rows('ag', 80, 'site_id', 10)} SELECT site_id, {_pivot(_MAX)} FROM k GROUP BY site_id")
def find_time_traces(spark, folder):
    """The site grain is merged from the moments of sites and years."""
    moments = aggregate_moments(merged(spark, folder), ["site_id", "target", "year"])
    return op.trace_matrix(op.both_grains(moments)[0], ["site_id"], 30, 80, 10, TARGETS)


@query("find_time_traces_year", f"{_rows('ay', 10, '(site_id, year)', 50)} SELECT site_id, year, {_pivot(_MAX)} FROM k GROUP BY site_id, year")
def find_time_traces_year(spark, folder):
    return _year_traces(spark, folder)


@query("select_time_trace", f"""{_rows('ay', 10, '(site_id, year)', 50)}
SELECT site_id, year, CAST(sampled_on AS VARCHAR) AS sampled_on, target, value FROM me
WHERE site_id = 1 AND target = 'PROMO' AND year IN (SELECT year FROM k WHERE site_id = 1 AND target = 'PROMO')""")
def select_time_trace(spark, folder):
    rows = op.select_time_trace(merged(spark, folder).where(col("target") == "PROMO"), _year_traces(spark, folder, ["PROMO"]), 1, "PROMO")
    return rows.select("site_id", "year", col("sampled_on").cast("string").alias("sampled_on"), "target", "value")
