"""Metrics of binary forecasts, as aggregate Columns.

Precision, recall and F1 are 0 where their denominator is 0.  The confusion matrix is always
2 x 2, ``[[tn, fp], [fn, tp]]``, also when only one class occurs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cells(y: Column, pred: Column) -> dict[str, Column]:
    """Counts of the four outcomes; rows where either side is null count nowhere."""
    return {
        "tn": F.count_if((y == 0) & (pred == 0)),
        "fp": F.count_if((y == 0) & (pred == 1)),
        "fn": F.count_if((y == 1) & (pred == 0)),
        "tp": F.count_if((y == 1) & (pred == 1)),
    }


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores(c: dict[str, Column]) -> dict[str, Column]:
    """Accuracy, precision, recall and F1 of counts."""
    tn, fp, fn, tp = (c[k] for k in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": ratio(tp + tn, tn + fp + fn + tp),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def confusion_matrix(c: dict[str, Column]) -> Column:
    return F.array(F.array(c["tn"], c["fp"]), F.array(c["fn"], c["tp"]))


def predicted(score: Column, threshold: Column | float) -> Column:
    """1 where the score reaches the threshold, 0 below, null without a score."""
    return (score >= threshold).cast("int")
