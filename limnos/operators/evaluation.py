"""Judging predictions. Everything follows from the table of (actual, predicted) counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from limnos.functions.nulls import fill_null, one_row, ratio


def confusion_matrix(pred: DataFrame, labels: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Actual x predicted counts, one column per label."""
    counts = pred.groupBy(actual).pivot(predicted, list(labels)).agg(F.count(F.lit(1)))
    return fill_null(counts, [str(x) for x in labels], 0)


def class_counts(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Per label: rows that have it, rows that were given it, and rows that were given it rightly."""
    pairs = pred.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(zero)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("support"), zero.alias("given"), hit.alias("hits")),
        F.struct(F.col("p").alias("label"), zero.alias("support"), F.col("n").alias("given"), zero.alias("hits")))))
    return (both.dropna(subset=["label"]).groupBy("label")
            .agg(*[F.sum(c).alias(c) for c in ("support", "given", "hits")]))


def overall_statistics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: rows, accuracy and Cohen's kappa."""
    total = class_counts(pred, actual, predicted).agg(
        F.sum("support").alias("n"), F.sum("hits").alias("hits"),
        F.sum(F.col("support").cast("double") * F.col("given")).alias("chance"))
    po = ratio(F.col("hits"), F.col("n"))
    pe = ratio(F.col("chance"), F.col("n").cast("double") * F.col("n"))
    return total.select("n", po.alias("accuracy"), F.try_divide(po - pe, 1.0 - pe).alias("kappa"))


def class_statistics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Sensitivity and specificity per label."""
    counts = class_counts(pred, actual, predicted)
    n = one_row(pred.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    others = n - F.col("support")
    return counts.select("label", "support", "given", "hits", ratio(F.col("hits"), F.col("support")).alias("sensitivity"),
                         ratio(others - (F.col("given") - F.col("hits")), others).alias("specificity"))


def classification_report(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per label, then accuracy, macro and weighted means."""
    zero = F.lit(0.0)
    p = F.coalesce(ratio(F.col("hits"), F.col("given")), zero)
    r = F.coalesce(ratio(F.col("hits"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(2.0 * p * r, p + r), zero)
    per_label = class_counts(pred, actual, predicted).select(
        F.col("label").cast("string").alias("label"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support", "hits")
    measures = ("precision", "recall", "f1")
    sums = per_label.agg(
        F.sum("support").alias("support"), ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in measures],
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in measures])
    lines = F.array(
        F.struct(F.lit("accuracy").alias("label"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"),
                 F.col("accuracy").alias("f1"), F.col("support").alias("support")),
        *[F.struct(F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind}_{c}").alias(c) for c in measures],
                   F.col("support").alias("support")) for kind in ("macro", "weighted")])
    return per_label.drop("hits").unionByName(sums.select(F.inline(lines)))
