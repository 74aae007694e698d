"""The European workflow: merge, aggregate, select traces, prepare the water-body classification."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from limnos.functions.nulls import col, drop_null_rows
from limnos.operators.aggregates import aggregate_stats
from limnos.operators.columns import WATER_BODY_NAMES, derive_period, recode_categories
from limnos.operators.evaluation import classification_report
from limnos.operators.features import (apply_scaling, drop_small_classes, fit_scaling, scale_population, stratified_split,
                                       targets_for_water_bodies, undersample)
from limnos.operators.joins import priority_dedupe_sites
from limnos.operators.models import classify_linear_svc, classify_random_forest, classify_svc_rbf, kmeans, pca
from limnos.operators.neighbours import classify_knn
from limnos.session import staged


def merge_measurements(meas: DataFrame, sites: DataFrame) -> DataFrame:
    """Valued measurements of known sites with country, basin, position, water-body name, year, month, season.

    Metadata is reduced to one row per site first, so the inner join is both the membership test and
    the lookup.
    """
    known = priority_dedupe_sites(sites).select("site_id", "site_name", "country", "rbd", "lon", "lat")
    merged = meas.where(col("value").isNotNull()).join(known, "site_id")
    return derive_period(recode_categories(merged, "wb_code", WATER_BODY_NAMES), "sampled_on")


def site_target_year(meas: DataFrame, sites: DataFrame) -> DataFrame:
    """Mean, spread and share below LOQ for each site, target and year."""
    return aggregate_stats(merge_measurements(meas, sites), ["site_id", "target", "year"])


def water_body_matrix(agg_site: DataFrame, targets: list[str]) -> DataFrame:
    """Site means as a matrix over the given targets, scaled, complete rows only."""
    wide = agg_site.groupBy("site_id", "wb_code").pivot("target", targets).agg(F.max("mean"))
    wide = drop_null_rows(wide, targets, "all")
    return drop_null_rows(scale_population(wide, targets), targets)


def prep_water_body(agg_site: DataFrame, agg_wb: DataFrame, max_below_loq_pct: float = 20, min_samples: int = 5000,
                    top: int = 6, min_sites: int = 0, rebalance: bool = True, train: float = 0.5,
                    seed: int = 0) -> DataFrame:
    """Balanced, scaled site matrix with a train/test column, from two aggregates.

    The label stays a column, so it cannot drift from its row. Only the target names (at most ``top``)
    reach the driver.
    """
    chosen = [r.target for r in targets_for_water_bodies(agg_wb, max_below_loq_pct, min_samples, top).collect()]
    if not chosen:
        raise ValueError("no target passes the thresholds")
    data = staged(water_body_matrix(agg_site.where(col("target").isin(chosen)), chosen))
    if min_sites:
        data = drop_small_classes(data, "wb_code", min_sites)
    if rebalance:
        data = staged(undersample(data, "wb_code", ["site_id"], seed))
    return stratified_split(data, "wb_code", ["site_id"], train, seed + 1)


#: Classifiers of the workflow: functions of scaled train and test rows, the label and the columns.
CLASSIFIERS: Mapping[str, Callable[[DataFrame, DataFrame, str, Sequence[str]], DataFrame]] = {
    "linear_svc": lambda train, test, label, columns: classify_linear_svc(train, test, ["site_id"], label, columns),
    "k_neighbours": lambda train, test, label, columns: classify_knn(train, test, "site_id", label, columns, 5),
    "svc": lambda train, test, label, columns: classify_svc_rbf(train, test, ["site_id"], label, columns),
    "random_forest": lambda train, test, label, columns: classify_random_forest(train, test, ["site_id"], label, columns),
}


class FittedPlan(NamedTuple):
    """What the training rows decided: the columns, their scaling, the label and the classifier; it is applied to any other rows."""
    train: DataFrame
    scaling: Mapping[str, tuple[float, float]]
    label: str
    method: str

    def predict(self, rows: DataFrame) -> DataFrame:
        """``site_id, actual, predicted`` of complete rows, scaled by the training rows' mean and sd."""
        columns = list(self.scaling)
        scaled = [apply_scaling(drop_null_rows(df, columns), self.scaling) for df in (self.train, rows)]
        return CLASSIFIERS[self.method](*scaled, self.label, columns)

    def report(self, rows: DataFrame) -> DataFrame:
        """Precision, recall, F1 and support per class, with accuracy and means."""
        return classification_report(staged(self.predict(rows)))


def fit_plan(prepared: DataFrame, columns: Sequence[str], method: str, label: str = "wb_code") -> FittedPlan:
    """Plan of the training rows (``split`` = train) of ``prep_water_body``; an unknown method raises."""
    if method not in CLASSIFIERS:
        raise ValueError(f"unknown method {method}; known are {', '.join(CLASSIFIERS)}")
    train = staged(prepared.where(col("split") == "train"))
    return FittedPlan(train, fit_scaling(train, columns), label, method)


def classify_water_bodies(prepared: DataFrame, columns: Sequence[str], method: str, label: str = "wb_code") -> DataFrame:
    """Report of a classifier fitted to the training rows and applied to the test rows."""
    prepared = staged(prepared)
    return fit_plan(prepared, columns, method, label).report(prepared.where(col("split") == "test"))


def cluster_water_bodies(prepared: DataFrame, columns: Sequence[str], clusters: int = 2, label: str = "wb_code") -> DataFrame:
    """Rows of each label in each cluster."""
    return kmeans(prepared, columns, clusters).groupBy(label, "cluster").agg(F.count(F.lit(1)).alias("n"))


def project_water_bodies(prepared: DataFrame, columns: Sequence[str], components: int = 2) -> tuple[DataFrame, DataFrame]:
    """Components of each row, with its site and label, and the share of variance of each component."""
    scores, ratios, _ = pca(prepared.drop("split"), columns, components)
    return scores, ratios
