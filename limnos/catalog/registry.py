"""Registry of queries and of the oracle SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from limnos.functions.nulls import col
from limnos.operators.aggregates import group_stats
from limnos.plans.europe import merge_measurements
from limnos.session import shared_folder
from limnos.sources import driver_tables as tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TARGETS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BASINS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
WATER_BODIES = ["coastal", "ground", "lake", "river", "transitional"]

_NAMES = {t: t for t in ("lineitem", "part", "supplier", "nation", "region")}
_PERIOD = """CAST(year({0}) AS INTEGER) AS year, CAST(month({0}) AS INTEGER) AS month,
  CASE WHEN month({0}) BETWEEN 4 AND 9 THEN 'summer' WHEN month({0}) IS NOT NULL THEN 'winter' END AS season"""
_STATS = """count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
  CAST(sum(CASE WHEN below_loq THEN 1 WHEN NOT below_loq THEN 0 END) AS BIGINT) AS below_loq_sum,
  sum(CASE WHEN below_loq THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / nullif(count(value), 0) AS below_loq_pct"""

# Views the oracles share, in order of dependence.
VIEWS = {
    "m": tables.MEASUREMENTS_SQL.format(**_NAMES),
    "st": tables.SITES_SQL.format(**_NAMES),
    "sd": """SELECT site_id, site_name, country, rbd, lon, lat, scheme FROM (
        SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY scheme DESC) AS r FROM st WHERE site_id IS NOT NULL)
        WHERE r = 1""",
    "mp": f"SELECT *, {_PERIOD.format('sampled_on')} FROM m",
    "me": f"""SELECT m.* REPLACE (CASE wb_code WHEN 'RW' THEN 'river' WHEN 'GW' THEN 'ground' WHEN 'CW' THEN 'coastal'
        WHEN 'TeW' THEN 'territorial' WHEN 'TW' THEN 'transitional' WHEN 'LW' THEN 'lake' ELSE wb_code END AS wb_code),
        sd.site_name, sd.country, sd.rbd, sd.lon, sd.lat, {_PERIOD.format('sampled_on')}
        FROM m JOIN sd ON m.site_id = sd.site_id WHERE value IS NOT NULL""",
    "ag": f"SELECT site_id, target, {_STATS} FROM me GROUP BY ALL",
    "ay": f"SELECT site_id, target, year, {_STATS} FROM me GROUP BY ALL",
    "aw": f"SELECT wb_code, target, {_STATS} FROM me GROUP BY ALL",
    "asw": f"SELECT site_id, wb_code, target, {_STATS} FROM me GROUP BY ALL",
    "ase": f"SELECT site_id, target, season, {_STATS} FROM me GROUP BY ALL",
}


def with_views(sql: str) -> str:
    """Put the views a query uses, and what they depend on, in front of it."""
    import re

    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(body)
    if not needed:
        return sql
    chain = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    text = sql.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {chain},\n{text[5:]}"
    return f"WITH {chain}\n{text}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles for comparison between engines; adding zero turns -0.0 into 0.0."""
    return df.select(*[(F.round(col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else col(f.name)
                       for f in df.schema.fields])


def query(name: str, sql: str | None = None, digits: int = 4):
    """Register a query under its key; doubles are rounded, also in the oracle.

    In the SQL, ``R(expression)`` stands for rounding to the same digits.
    """
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(function(spark, folder), digits)

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _expand_rounding(with_views(sql), digits)
        return function

    return register


def _expand_rounding(sql: str, digits: int) -> str:
    out, i = [], 0
    while i < len(sql):
        if sql.startswith("R(", i) and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] == "_")):
            depth, j = 1, i + 2
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[j], 0)
                j += 1
            out.append(f"(round(CAST({_expand_rounding(sql[i + 2:j - 1], digits)} AS DOUBLE), {digits}) + 0e0)")
            i = j
        else:
            out.append(sql[i])
            i += 1
    return "".join(out)


def meas(spark: SparkSession, folder: str) -> DataFrame:
    return tables.measurements(spark, folder)


# Paths of derived tables, by application, table and folder.
_DERIVED: dict[tuple[str, str, str], str] = {}


def derived(spark: SparkSession, name: str, folder: str, write: Callable[[str], object]) -> str:
    """Path of a table written once per application to the shared folder."""
    key = (spark.sparkContext.applicationId, name, folder)
    if key not in _DERIVED:
        path = shared_folder(spark, name)
        write(path)
        _DERIVED[key] = path
    return _DERIVED[key]


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """Site metadata as a table of known size."""
    return spark.read.parquet(derived(spark, "sites", folder, tables.sites(spark, folder).write.parquet))


def merged(spark: SparkSession, folder: str) -> DataFrame:
    return merge_measurements(meas(spark, folder), sites(spark, folder))


def aggregated(spark: SparkSession, folder: str, *groups: str) -> DataFrame:
    """Group statistics of the merged table."""
    return group_stats(merged(spark, folder), groups)


def stats_columns(*names: str) -> str:
    """SQL select list of the group statistics, rounded."""
    return ", ".join([*names, "n", "R(mean) AS mean", "R(sd) AS sd", "below_loq_sum", "R(below_loq_pct) AS below_loq_pct"])
