"""2.3 Filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.catalog.registry import TARGETS, aggregated, meas, merged, query, stats_columns
from limnos.functions.nulls import col
from limnos.operators import filters as op
from limnos.operators.columns import below_loq_ratio
from limnos.operators.reshape import site_target_matrix

KEPT = ["site_id", "value", "below_loq"]


@query("filter_target", "SELECT site_id, value, below_loq FROM m WHERE target = 'PROMO' AND wb_code = 'RW'")
def filter_target(spark, folder):
    return op.filter_target(meas(spark, folder), "PROMO", "RW", KEPT)


@query("filter_target_group", "SELECT site_id, target, value, below_loq FROM m WHERE target IN ('LARGE', 'MEDIUM', 'SMALL')")
def filter_target_group(spark, folder):
    return op.filter_target_group(meas(spark, folder), "sizes", {"sizes": ("LARGE", "MEDIUM", "SMALL")}).select("site_id", "target", "value", "below_loq")


@query("filter_quantified", "SELECT site_id, target, value, below_loq FROM m WHERE NOT below_loq")
def filter_quantified(spark, folder):
    return op.filter_quantified(meas(spark, folder).select("site_id", "target", "value", "below_loq"))


@query("drop_missing", "SELECT site_id, target, value, depth FROM m WHERE value IS NOT NULL AND depth IS NOT NULL")
def drop_missing(spark, folder):
    return op.drop_missing(meas(spark, folder).select("site_id", "target", "value", "depth"), ["value", "depth"])


@query("filter_false_or_null", """
SELECT site_id, target, value, status FROM m
WHERE coalesce(NOT below_loq, true) AND coalesce(NOT (CASE WHEN status = 'U' THEN true WHEN status = 'A' THEN false END), true)
  AND (status IS NULL OR status = 'A')""")
def filter_false_or_null(spark, folder):
    flagged = meas(spark, folder).withColumn("unsure", F.when(col("status") == "U", True).when(col("status") == "A", False))
    kept = op.filter_status(op.filter_false_or_null(flagged, ["below_loq", "unsure"]))
    return kept.select("site_id", "target", "value", "status")


@query("filter_thresholds", f"SELECT {stats_columns('site_id', 'target', 'year')} FROM ay WHERE below_loq_pct < 30 AND n > 10")
def filter_thresholds(spark, folder):
    return op.filter_thresholds(aggregated(spark, folder, "site_id", "target", "year"), 30, 10)


@query("filter_in_list", "SELECT site_id, target, value FROM m WHERE target IN ('PROMO', 'SMALL', 'LARGE')")
def filter_in_list(spark, folder):
    return op.filter_in_list(meas(spark, folder).select("site_id", "target", "value"), "target", ["PROMO", "SMALL", "LARGE"])


@query("filter_years", """
SELECT site_id, target, year, country, wb_code, value FROM me
WHERE year BETWEEN 1996 AND 1999 AND year IN (1996, 1998, 2001) AND wb_code = 'river' AND country = 'NATION_1'""")
def filter_years(spark, folder):
    df = merged(spark, folder).select("site_id", "target", "year", "country", "wb_code", "value")
    return op.filter_years(df, 1996, 1999, [1996, 1998, 2001], "NATION_1", "river")


@query("complete_cases", f"""
WITH w AS (SELECT site_id, year, {", ".join(f"avg(value) FILTER (target = '{t}') AS {t}" for t in TARGETS)} FROM me GROUP BY ALL)
SELECT site_id, year, {", ".join(f"R({t}) AS {t}" for t in TARGETS)} FROM w WHERE {" AND ".join(f"{t} IS NOT NULL" for t in TARGETS)}""")
def complete_cases(spark, folder):
    wide = site_target_matrix(merged(spark, folder), TARGETS, ["site_id", "year"])
    return op.complete_cases(op.complete_cases(wide, TARGETS, "all"), TARGETS, "any")


@query("loq_classes", """
WITH r AS (SELECT site_id, target, year, below_loq_sum / CAST(nullif(n, 0) AS DOUBLE) AS q,
  CASE WHEN target = 'PROMO' THEN NULL ELSE 1.5 END AS loq_value FROM ay)
SELECT site_id, target, year, R(q) AS below_loq_ratio,
  CASE WHEN q = 1 THEN 'always_below' WHEN q = 0 THEN 'always_above' WHEN q > 0 AND q < 1 THEN 'mixed' END AS loq_class,
  loq_value IS NULL AS no_loq_value FROM r""")
def loq_classes(spark, folder):
    agg = below_loq_ratio(aggregated(spark, folder, "site_id", "target", "year"), "below_loq_sum", "n")
    agg = agg.withColumn("loq_value", F.when(col("target") != "PROMO", 1.5))
    return op.loq_classes(agg).select("site_id", "target", "year", "below_loq_ratio", "loq_class", "no_loq_value")
