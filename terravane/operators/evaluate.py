"""Evaluation of forecasts: metrics by split and model, ROC-AUC, threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions.metrics import cells, confusion_matrix, scores

#: Scores are in 0..1; ranks are summed up within so many bins of them before the bins are.
SCORE_BINS = 1024


def evaluate(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Counts, metrics and the confusion matrix of each group of a long table of forecasts."""
    counts = df.groupBy(*by).agg(*[c.alias(k) for k, c in cells(F.col(y), F.col(pred)).items()])
    c = {k: F.col(k) for k in ("tn", "fp", "fn", "tp")}
    return counts.withColumns(scores(c)).withColumn("confusion_matrix", confusion_matrix(c))


def roc_auc(df: DataFrame, by: Sequence[str], y: str = "y", prob: str = "prob") -> DataFrame:
    """The exact area under the ROC curve by group; null if only one class occurs; ties count half.

    Positives' mean ranks come from counts of the distinct scores.  They are summed up in bins of
    the score and then over the bins, so a group with many scores is no single task's work.
    """
    keys = list(by)
    rows = df.filter(F.col(prob).isNotNull() & F.col(y).isNotNull())
    distinct = rows.groupBy(*keys, F.col(prob).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    distinct = distinct.withColumn("bin", F.floor(F.col("s") * SCORE_BINS))
    bins = distinct.groupBy(*keys, "bin").agg(F.sum("n").alias("bin_n"))
    below = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_below", F.coalesce(F.sum("bin_n").over(below), F.lit(0))).drop("bin_n")
    inside = Window.partitionBy(*keys, "bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bins, [*keys, "bin"])
    wins = F.col("p") * (F.col("below") + F.col("bin_below") + F.col("n") / F.lit(2.0))
    sums = ranked.groupBy(*keys).agg(F.sum(wins).alias("w"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return sums.select(*keys, F.try_divide(F.col("w"), (F.col("pos") * F.col("neg")).cast("double")).alias("roc_auc"))


def roc_auc_pairs(df: DataFrame, y: str = "y", prob: str = "prob", bins: int = 1024) -> DataFrame:
    """The same by comparing positives with negatives, for checks.

    Scores are cut into bins of equal width; pairs of one bin meet in a join and are compared one
    by one (distinct scores only), pairs of different bins are counted by bins.
    """
    counts = df.filter(F.col(prob).isNotNull()).groupBy(F.col(prob).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    counts = counts.withColumn("bin", F.floor(F.col("s") * bins))
    a, b = counts.filter("p > 0").select("bin", F.col("s").alias("sp"), "p"), counts.filter("n > 0").select("bin", F.col("s").alias("sn"), "n")
    win = F.when(F.col("sp") > F.col("sn"), 1.0).when(F.col("sp") == F.col("sn"), 0.5).otherwise(0.0)
    near = a.join(b, "bin").agg(F.sum(win * F.col("p") * F.col("n")).alias("near"))
    # A row for each bin.
    totals = counts.groupBy("bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = totals.withColumn("below", below).agg(F.sum(F.col("p") * F.col("below")).alias("far"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    # One row each.
    both = far.join(F.broadcast(near))
    return both.select(F.try_divide(F.coalesce("near", F.lit(0.0)) + F.col("far"), (F.col("p") * F.col("n")).cast("double")).alias("roc_auc"))


def cut_offs(first: int = 10, last: int = 90, parts: int = 100) -> Column:
    """Thresholds first/parts .. last/parts, made of whole numbers so that they do not drift."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: i / F.lit(float(parts)))


def sweep(df: DataFrame, thresholds: Column, by: Sequence[str] = (), y: str = "y", prob: str = "prob") -> DataFrame:
    """Metrics at each threshold; ``predicted_stress`` counts the rows at or above it.

    Rows are first counted by score, so what is multiplied by the thresholds is no larger than
    the number of distinct scores.
    """
    keys = list(by)
    rows = df.filter(F.col(prob).isNotNull() & F.col(y).isNotNull())
    counts = rows.groupBy(*keys, F.col(prob).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    grid = counts.withColumn("threshold", F.explode(thresholds))
    hit = F.col("s") >= F.col("threshold")

    def total(c: str, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))

    sums = grid.groupBy(*keys, "threshold").agg(total("p", hit).alias("tp"), total("n", hit).alias("fp"), total("p", ~hit).alias("fn"), total("n", ~hit).alias("tn"))
    out = sums.withColumns(scores({k: F.col(k) for k in ("tn", "fp", "fn", "tp")}))
    return out.withColumn("predicted_stress", F.col("tp") + F.col("fp"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold with the best F1, the lowest of equals: one row, 0.5 if none reaches more than 0."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)
