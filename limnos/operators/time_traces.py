"""Selection of sites, targets and years with enough samples for a time trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limnos.functions.nulls import col
from limnos.operators.aggregates import roll_up_stats
from limnos.operators.filters import filter_false_or_null, filter_thresholds
from limnos.operators.joins import semi_known_sites, semi_site_years
from limnos.operators.reshape import count_matrix, pivot_values
from limnos.session import staged

# Fixed value: the catch-all target left out of the traces.
CATCH_ALL_TARGET = "Other chemical parameter"


def well_covered(rows: DataFrame, keys: list[str], at_least: int) -> DataFrame:
    """Rows of the targets that occur in at least so many key combinations."""
    cells = rows.select(*keys, "target").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("__cells"))
    return rows.join(staged(cells.where(F.col("__cells") >= at_least).select("target")), "target", "left_semi")


def source_trace_rows(agg: DataFrame, sites: DataFrame, min_samples: int = 100, min_sites: int = 10,
                      reliable_only: bool = False) -> DataFrame:
    """Long form of the selection from the source's own aggregates."""
    if reliable_only:
        agg = agg.where(col("status") == "A")
    rows = semi_known_sites(agg, sites)
    rows = filter_false_or_null(rows, ["median_below_loq", "max_below_loq", "mean_below_loq"])
    rows = staged(rows.where(col("n") > min_samples).select("site_id", "target", "year", "n"))
    return well_covered(rows, ["site_id"], min_sites)


def find_time_traces_source(agg: DataFrame, sites: DataFrame, min_samples: int = 100, min_sites: int = 10,
                            reliable_only: bool = False, targets: list[str] | None = None,
                            ) -> tuple[DataFrame, DataFrame]:
    """Count matrices by site and by site and year, from the source's own aggregates; both come out of one written selection."""
    rows = staged(source_trace_rows(agg, sites, min_samples, min_sites, reliable_only))
    targets = pivot_values(rows) if targets is None else targets
    return count_matrix(rows, targets), count_matrix(rows, targets, ["site_id", "year"])


def trace_rows(agg: DataFrame, keys: list[str], max_below_loq_pct: float, min_samples: int,
               min_cells: int) -> DataFrame:
    """Long form of the selection from custom aggregates: keys, target and sample count."""
    rows = filter_thresholds(agg, max_below_loq_pct, min_samples).where(col("target") != CATCH_ALL_TARGET)
    return well_covered(staged(rows.select(*keys, "target", "n")), keys, min_cells)


def find_time_traces(agg: DataFrame, agg_year: DataFrame, max_below_loq_pct: float = 30, min_samples: int = 300,
                     min_samples_per_year: int = 100, min_sites: int = 10, min_site_years: int = 50,
                     targets: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sample-count matrices by site and by site and year, from custom aggregates."""
    return (trace_matrix(agg, ["site_id"], max_below_loq_pct, min_samples, min_sites, targets),
            trace_matrix(agg_year, ["site_id", "year"], max_below_loq_pct, min_samples_per_year, min_site_years, targets))


def trace_matrix(agg: DataFrame, keys: list[str], max_below_loq_pct: float, min_samples: int, min_cells: int,
                 targets: list[str] | None = None) -> DataFrame:
    """One sample-count matrix, from custom aggregates by its keys and target.

    Dropping the sparse targets before the pivot leaves no empty row behind.
    """
    rows = trace_rows(agg, keys, max_below_loq_pct, min_samples, min_cells)
    return rows.groupBy(*keys).pivot("target", pivot_values(rows) if targets is None else targets).agg(F.max("n"))


def both_grains(moments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statistics by site and target, and by site, target and year, merged from one written table of the finer ``aggregate_moments``."""
    fine = staged(moments)
    return roll_up_stats(fine, ["site_id", "target"]), roll_up_stats(fine, ["site_id", "target", "year"])


def select_time_trace(meas: DataFrame, traces: DataFrame, site, target: str) -> DataFrame:
    """Measurements of one site and target in the years that qualified (wide traces by site and year)."""
    pairs = traces.where((col("site_id") == site) & col(target).isNotNull())
    return semi_site_years(meas.where(col("site_id") == site), pairs, target)
