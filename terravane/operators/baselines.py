"""Baseline forecasts: persistence and seasonal climatology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.metrics import predicted


def persistence(df: DataFrame, flag: str = "current_stress") -> DataFrame:
    """The present state, carried one step on, as ``pred``; it has no probability."""
    return df.withColumn("pred", F.col(flag).cast("int")).withColumn("prob", F.lit(None).cast("double"))


def climatology(df: DataFrame, train: DataFrame, target: str = "target_stress_next", season: str = "month", partition_by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """The training rate of the target in the row's season as ``prob``, and ``pred``.

    A season that training lacks gets the rate over all training rows (of its partition).
    """
    keys = list(partition_by)
    rates = train.groupBy(*keys, season).agg(F.avg(target).alias("_rate"))
    overall = train.groupBy(*keys).agg(F.avg(target).alias("_all"))
    out = df.join(rates, [*keys, season], "left")
    # Without partitions there is one overall rate.
    out = out.join(overall, keys, "left") if keys else out.join(F.broadcast(overall))
    out = out.withColumn("prob", F.coalesce("_rate", "_all")).drop("_rate", "_all")
    return out.withColumn("pred", predicted(F.col("prob"), threshold))
