"""The season workflow: common targets and countries, recap, season matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame

from limnos.functions.nulls import drop_null_rows
from limnos.operators.aggregates import common_to_all_groups, recap_sampling, top_k_targets
from limnos.operators.columns import SEASON_LETTERS, recode_categories
from limnos.operators.joins import first_per_key
from limnos.operators.reshape import pivot_fill_absent, pivot_multi, pivot_values
from limnos.session import staged

MEASURES = ("mean", "sd", "n", "below_loq_sum", "below_loq_pct")
SITE_KEYS = ("site_id", "season", "lat", "lon", "country", "rbd")


def season_table(agg: DataFrame, sites: DataFrame, k: int = 10) -> DataFrame:
    """Season aggregates of the k most widespread targets in the countries common to all target-season groups."""
    rows = agg.join(sites.distinct(), "site_id", "left").dropna(subset=["lat", "lon", "rbd"]).distinct()
    rows = staged(recode_categories(rows, "season", SEASON_LETTERS))
    rows = top_k_targets(rows, k, distinct="site_id")
    rows = staged(first_per_key(rows, ["site_id", "target", "season"], ["lat", "lon"]))
    countries = common_to_all_groups(rows, ["target", "season"], "country")
    return rows.join(staged(countries.select("country")), "country", "left_semi")


def season_recap(rows: DataFrame) -> DataFrame:
    return recap_sampling(rows, ["target", "country", "season"])


def season_matrix(rows: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """One row per site and season; ``fill`` for absent cells, or complete means only when it is None."""
    targets = pivot_values(rows)
    if fill is not None:
        return pivot_fill_absent(rows, SITE_KEYS, MEASURES, targets, fill=fill)
    wide = pivot_multi(rows, SITE_KEYS, MEASURES, targets)
    return drop_null_rows(wide, [f"mean_{t}" for t in targets])
