"""2.4 Joins, duplicates, sets, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.catalog.registry import aggregated, meas, merged, query, sites, stats_columns
from limnos.functions.nulls import col
from limnos.operators import joins as op
from limnos.operators import quality
from limnos.operators.aggregates import group_stats
from limnos.operators.columns import derive_period
from limnos.operators.time_traces import trace_rows
from limnos.sources.driver_tables import table


@query("enrich_sites", """
SELECT m.site_id, target, value, country, rbd FROM m LEFT JOIN sd ON m.site_id = sd.site_id""")
def enrich_sites(spark, folder):
    known = op.priority_dedupe_sites(sites(spark, folder)).select("site_id", "country", "rbd")
    return op.enrich_sites(meas(spark, folder).select("site_id", "target", "value"), known)


@query("semi_known_sites", "SELECT site_id, target, value FROM m WHERE site_id IN (SELECT site_id FROM st WHERE site_id IS NOT NULL)")
def semi_known_sites(spark, folder):
    return op.semi_known_sites(meas(spark, folder).select("site_id", "target", "value"), sites(spark, folder))


@query("anti_unmatched_sites", """
SELECT site_id, count(*) AS n FROM m WHERE site_id NOT IN (SELECT site_id FROM st WHERE site_id IS NOT NULL) GROUP BY site_id""")
def anti_unmatched_sites(spark, folder):
    return op.anti_unmatched_sites(meas(spark, folder), sites(spark, folder))


@query("drop_ambiguous_keys", """
SELECT site_id, site_name, scheme FROM (SELECT *, count(*) OVER (PARTITION BY site_id) AS c FROM st) WHERE c <= 1""")
def drop_ambiguous_keys(spark, folder):
    return op.drop_ambiguous_keys(sites(spark, folder).select("site_id", "site_name", "scheme"), ["site_id"])


@query("semi_site_years", """
SELECT site_id, year, target, value FROM me
WHERE target = 'PROMO' AND (site_id, year) IN (SELECT (site_id, year) FROM ay WHERE target = 'PROMO' AND n > 10 AND below_loq_pct < 30)""")
def semi_site_years(spark, folder):
    agg = aggregated(spark, folder, "site_id", "target", "year").where(col("target") == "PROMO")
    pairs = trace_rows(agg, ["site_id", "year"], 30, 10, 1)
    return op.semi_site_years(merged(spark, folder).select("site_id", "year", "target", "value"), pairs, "PROMO")


@query("semi_common_years", """
SELECT country, year, target, value FROM me WHERE year IN (SELECT year FROM me WHERE country = 'NATION_1')""")
def semi_common_years(spark, folder):
    return op.semi_common_years(merged(spark, folder).select("country", "year", "target", "value"), "NATION_1")


@query("right_join_labels", f"""
SELECT site_id, site_name, {stats_columns('target')} FROM sd RIGHT JOIN
  (SELECT site_id, target, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
   CAST(sum(CASE WHEN below_loq THEN 1 ELSE 0 END) AS BIGINT) AS below_loq_sum,
   sum(CASE WHEN below_loq THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / nullif(count(value), 0) AS below_loq_pct FROM m GROUP BY ALL) g
  USING (site_id)""")
def right_join_labels(spark, folder):
    labels = op.priority_dedupe_sites(sites(spark, folder)).select("site_id", "site_name")
    return op.right_join_labels(labels, group_stats(meas(spark, folder), ["site_id", "target"]), "site_id")


@query("full_outer_year_compare", """
SELECT coalesce(a.year, b.year) AS year, n_aggregated, n_raw FROM
  (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_aggregated FROM orders GROUP BY 1) a
  FULL JOIN (SELECT year, count(*) AS n_raw FROM mp GROUP BY year) b ON a.year = b.year""")
def full_outer_year_compare(spark, folder):
    agg = table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return op.full_outer_year_compare(agg, derive_period(meas(spark, folder), "sampled_on"))


@query("join_scalar_total", """
SELECT target, count(DISTINCT site_id) AS n_distinct,
  R(count(DISTINCT site_id) * CAST(100 AS DOUBLE) / (SELECT count(DISTINCT site_id) FROM m)) AS share_pct
FROM m WHERE NOT below_loq GROUP BY target""")
def join_scalar_total(spark, folder):
    m = meas(spark, folder)
    quantified = m.withColumn("target", F.when(~col("below_loq"), col("target")))
    return op.join_scalar_total(quantified, "target", "site_id").dropna(subset=["target"])


@query("dedupe_rows", "SELECT DISTINCT site_id, target, uom, status FROM m")
def dedupe_rows(spark, folder):
    return op.dedupe_rows(meas(spark, folder).select("site_id", "target", "uom", "status"))


@query("first_per_key", """
SELECT site_id, target, CAST(sampled_on AS VARCHAR) AS sampled_on, value, sample_id FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, target ORDER BY sampled_on DESC NULLS LAST, value NULLS LAST, sample_id) AS r FROM m)
WHERE r = 1""")
def first_per_key(spark, folder):
    df = meas(spark, folder).select("site_id", "target", "sampled_on", "value", "sample_id")
    first = op.first_per_key(df, ["site_id", "target"], ["sampled_on", "value", "sample_id"], ["sampled_on"])
    return first.withColumn("sampled_on", col("sampled_on").cast("string"))


@query("priority_dedupe_sites", "SELECT site_id, site_name, country, rbd, R(lon) AS lon, R(lat) AS lat, scheme FROM sd")
def priority_dedupe_sites(spark, folder):
    return op.priority_dedupe_sites(sites(spark, folder))


@query("duplicate_report", """
WITH d AS (SELECT *, count(*) OVER (PARTITION BY site_id) AS c FROM st)
SELECT scheme, count(*) AS rows_total, count(*) FILTER (site_id IS NOT NULL AND c > 1) AS rows_repeated,
  count(DISTINCT site_id) FILTER (site_id IS NOT NULL AND c > 1) AS keys_repeated FROM d GROUP BY scheme""")
def duplicate_report(spark, folder):
    return op.duplicate_report(sites(spark, folder), "site_id", "scheme")


@query("union_parts", """
SELECT site_id, site_name, scheme FROM (SELECT *, count(*) OVER (PARTITION BY site_id) AS c FROM st) WHERE c <= 1
UNION ALL SELECT site_id, site_name, scheme FROM sd WHERE site_id IN (SELECT site_id FROM st GROUP BY site_id HAVING count(*) > 1)""")
def union_parts(spark, folder):
    s = sites(spark, folder).select("site_id", "site_name", "scheme")
    once = op.drop_ambiguous_keys(s, ["site_id"])
    repeated = op.priority_dedupe_sites(s).join(once.select("site_id"), "site_id", "left_anti")
    return op.union_parts(once, repeated)


@query("intersect_sets", """
SELECT DISTINCT country FROM me WHERE season = 'summer' AND target = 'PROMO'
INTERSECT SELECT DISTINCT country FROM me WHERE season = 'winter' AND target = 'SMALL'""")
def intersect_sets(spark, folder):
    m = merged(spark, folder)
    return op.intersect_sets(m.where("season = 'summer' AND target = 'PROMO'").select("country"),
                             m.where("season = 'winter' AND target = 'SMALL'").select("country"))


@query("except_sets", "SELECT site_id FROM m EXCEPT SELECT site_id FROM st")
def except_sets(spark, folder):
    return op.except_sets(meas(spark, folder).select("site_id"), sites(spark, folder).select("site_id"))


@query("integrity_check", """
SELECT count(DISTINCT m.site_id) AS sites_used, count(DISTINCT sd.site_id) AS sites_matched,
  CAST(count(*) FILTER (m.site_id IS NULL) AS BIGINT) AS null_sites_in_data,
  R(count(DISTINCT sd.site_id) * CAST(100 AS DOUBLE) / count(DISTINCT m.site_id)) AS matched_pct,
  count(DISTINCT m.site_id) = count(DISTINCT sd.site_id) AS all_matched,
  (SELECT count(*) FROM st WHERE site_id IS NULL) AS null_sites_in_metadata,
  (SELECT count(*) FROM (SELECT site_id FROM st WHERE site_id IS NOT NULL GROUP BY site_id HAVING count(*) > 1)) AS repeated_sites_in_metadata
FROM m LEFT JOIN sd ON m.site_id = sd.site_id""")
def integrity_check(spark, folder):
    return op.integrity_check(meas(spark, folder), sites(spark, folder))


@query("column_profile", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
    f"count(DISTINCT {c}) AS n_distinct, R((count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*)) AS null_pct FROM m"
    for c, kind in (("site_id", "bigint"), ("wb_code", "string"), ("target", "string"), ("uom", "string"), ("sampled_on", "date"),
                    ("value", "double"), ("below_loq", "boolean"), ("depth", "int"), ("status", "string"))))
def column_profile(spark, folder):
    return quality.column_profile(meas(spark, folder).drop("sample_id"))
