"""The Swiss workflow: clean and join, site matrix, split."""

from __future__ import annotations

from pyspark.sql import DataFrame

from limnos.operators.columns import (WATER_BODY_NAMES, drop_empty_columns, recode_categories, wgs84_to_lv95)
from limnos.operators.features import impute_zero, scale_population, stratified_split, targets_in_every_category
from limnos.operators.joins import enrich_sites, priority_dedupe_sites
from limnos.operators.reshape import pivot_values, site_target_matrix
from limnos.session import staged


def merge_data(meas: DataFrame, sites: DataFrame) -> DataFrame:
    """Measurements without empty columns, joined to sites with Swiss coordinates and named water bodies."""
    located = wgs84_to_lv95(priority_dedupe_sites(sites), "lon", "lat")
    return recode_categories(enrich_sites(drop_empty_columns(meas), located), "wb_code", WATER_BODY_NAMES)


def prep_features(merged: DataFrame, train: float = 0.5, seed: int = 0) -> DataFrame:
    """Site x target means of the targets seen in every basin, scaled, nulls to 0, with a train/test column."""
    valued = merged.dropna(subset=["value", "rbd"])
    targets = pivot_values(targets_in_every_category(valued, "rbd"))
    if not targets:
        raise ValueError("no target occurs in every basin")
    matrix = staged(site_target_matrix(valued, targets))
    ready = staged(impute_zero(scale_population(matrix, targets), targets))
    return stratified_split(ready, "wb_code", ["site_id"], train, seed)
