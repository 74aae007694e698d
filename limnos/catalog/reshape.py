"""2.9 Long to wide and back."""

from __future__ import annotations

from limnos.catalog.registry import BASINS, TARGETS, WATER_BODIES, aggregated, meas, merged, query
from limnos.operators import reshape as op
from limnos.operators.columns import derive_period


def cells(form: str, names=TARGETS, quoted: str = '"{t}"') -> str:
    """SQL select list with one entry per pivot column."""
    return ", ".join(f"{form.format(t=t)} AS {quoted.format(t=t)}" for t in names)


BASIN_COUNT = "nullif(count(*) FILTER (rbd = '{t}'), 0)"
BODY_COUNT = "max(n) FILTER (wb_code = '{t}')"
AVG = "R(avg(value) FILTER (target = '{t}'))"


@query("site_target_matrix", f"SELECT site_id, wb_code, rbd, {cells(AVG)} FROM me GROUP BY ALL")
def site_target_matrix(spark, folder):
    return op.site_target_matrix(merged(spark, folder), TARGETS)


@query("count_matrix", f"""
SELECT site_id, year, {cells("CASE WHEN count(*) FILTER (target = '{t}') > 0 THEN count(value) FILTER (target = '{t}') END")}
FROM mp GROUP BY site_id, year""")
def count_matrix(spark, folder):
    return op.count_matrix(derive_period(meas(spark, folder), "sampled_on"), TARGETS, ["site_id", "year"], "value")


@query("targets_per_category", f"SELECT target, {cells(BASIN_COUNT, BASINS)} FROM me GROUP BY target")
def targets_per_category(spark, folder):
    return op.targets_per_category(merged(spark, folder), "rbd", BASINS)


def _multi(values: dict[str, str]) -> str:
    return ", ".join(f"{form.format(t=t)} AS \"{v}_{t}\"" for v, form in values.items() for t in TARGETS)


@query("pivot_multi", f"""
SELECT site_id, season, {_multi({"mean": "R(max(mean) FILTER (target = '{t}'))", "sd": "R(max(sd) FILTER (target = '{t}'))",
                                 "n": "max(n) FILTER (target = '{t}')"})} FROM ase GROUP BY ALL""")
def pivot_multi(spark, folder):
    return op.pivot_multi(aggregated(spark, folder, "site_id", "target", "season"), ["site_id", "season"], ["mean", "sd", "n"], TARGETS)


@query("pivot_fill_absent", f"""
SELECT site_id, year, {_multi({
    "sd": "R(CASE WHEN count(*) FILTER (target = '{t}') = 0 THEN 0 ELSE max(sd) FILTER (target = '{t}') END)",
    "n": "CAST(CASE WHEN count(*) FILTER (target = '{t}') = 0 THEN 0 ELSE max(n) FILTER (target = '{t}') END AS BIGINT)"})}
FROM ay WHERE n < 8 GROUP BY ALL""")
def pivot_fill_absent(spark, folder):
    few = aggregated(spark, folder, "site_id", "target", "year").where("n < 8")
    return op.pivot_fill_absent(few, ["site_id", "year"], ["sd", "n"], TARGETS)


_STATS = ("mean", "sd", "n")


@query("unpivot_stats", "SELECT site_id, " + ", ".join(
    f"R(max({s}) FILTER (target = '{t}')) AS \"{t}-{s}\"" for t in TARGETS for s in _STATS) + " FROM ag GROUP BY site_id")
def unpivot_stats(spark, folder):
    return op.unpivot_stats(aggregated(spark, folder, "site_id", "target"), ["site_id"], _STATS, TARGETS)


@query("unpivot_long", """
SELECT site_id, target, type, R(value) AS value FROM (
  SELECT site_id, target, 'mean' AS type, mean AS value FROM ag UNION ALL SELECT site_id, target, 'sd', sd FROM ag
  UNION ALL SELECT site_id, target, 'n', CAST(n AS DOUBLE) FROM ag)""")
def unpivot_long(spark, folder):
    return op.to_long(aggregated(spark, folder, "site_id", "target"), ["site_id", "target"], _STATS)


@query("drop_sparse_columns", """
WITH w AS (SELECT site_id, year, target, n FROM ay WHERE below_loq_pct < 30)
SELECT site_id, year, max(n) FILTER (target = 'ECONOMY') AS "ECONOMY", max(n) FILTER (target = 'LARGE') AS "LARGE",
  max(n) FILTER (target = 'MEDIUM') AS "MEDIUM", max(n) FILTER (target = 'PROMO') AS "PROMO",
  max(n) FILTER (target = 'STANDARD') AS "STANDARD"
FROM w GROUP BY ALL HAVING max(n) FILTER (target <> 'SMALL') IS NOT NULL""")
def drop_sparse_columns(spark, folder):
    agg = aggregated(spark, folder, "site_id", "target", "year").where("below_loq_pct < 30")
    wide = op.pivot_multi(agg, ["site_id", "year"], ["n"], TARGETS)
    wide = wide.toDF("site_id", "year", *TARGETS)
    cells_per_column = agg.select("site_id", "year").distinct().count() // 2
    return op.drop_sparse_columns(wide, ["site_id", "year"], min_filled=cells_per_column)


@query("order_columns_by_total", """
WITH r AS (SELECT target, sum(n) AS s, row_number() OVER (ORDER BY sum(n) DESC, target) AS r FROM aw GROUP BY target)
SELECT a.wb_code, max(n) FILTER (r = 1) AS rank_1, max(n) FILTER (r = 2) AS rank_2, max(n) FILTER (r = 3) AS rank_3
FROM aw a JOIN r USING (target) GROUP BY a.wb_code""")
def order_columns_by_total(spark, folder):
    wide = op.pivot_multi(aggregated(spark, folder, "wb_code", "target"), ["wb_code"], ["n"], TARGETS)
    return op.order_columns_by_total(wide, ["wb_code"], 3).toDF("wb_code", "rank_1", "rank_2", "rank_3")


@query("wb_target_counts", f"SELECT target, {cells(BODY_COUNT, WATER_BODIES)} FROM aw GROUP BY target")
def wb_target_counts(spark, folder):
    agg = aggregated(spark, folder, "wb_code", "target")
    return op.pivot_multi(agg, ["target"], ["n"], WATER_BODIES, names="wb_code").toDF("target", *WATER_BODIES)
