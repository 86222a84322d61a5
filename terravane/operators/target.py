"""Seasonal thresholds learned on training years, event flags and next-step targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.calendar import in_years
from terravane.operators.quantile import exact_quantiles
from terravane.operators.series import shifted


def seasonal_threshold(df: DataFrame, value: str, train_until: int, q: float = 0.25, season: str = "month", time: str = "time", partition_by: Sequence[str] = ()) -> DataFrame:
    """The exact q-quantile, linearly interpolated, of each season over the training years.

    For a series: a group has a value for each training year, and is held as a map of its values.
    ``observed_threshold`` is for groups of any size.
    """
    train = df.filter(in_years(F.col(time), last=train_until))
    return train.groupBy(*partition_by, season).agg(F.percentile(value, F.lit(q)).alias("stress_threshold"))


def observed_threshold(df: DataFrame, value: str, train_until: int, q: float = 0.25, season: str = "month", time: str = "time", partition_by: Sequence[str] = ()) -> DataFrame:
    """The same threshold of single observations, as many as there may be in a season.

    NaN and infinite values are missing; see ``quantile.exact_quantiles``.
    """
    train = df.filter(in_years(F.col(time), last=train_until))
    return exact_quantiles(train, value, [q], [*partition_by, season]).select(*partition_by, season, F.col("value").alias("stress_threshold"), "n")


def flagged(df: DataFrame, thresholds: DataFrame, value: str, season: str = "month", partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds the threshold and ``current_stress``: strictly below it.  A season without threshold raises when run."""
    # A row for each season and partition; Spark broadcasts it when its size allows.
    joined = df.join(thresholds, [*partition_by, season], "left")
    guard = F.when(F.col("stress_threshold").isNull(), F.raise_error(F.lit("a season has no threshold")).cast("double")).otherwise(F.col("stress_threshold"))
    joined = joined.withColumn("stress_threshold", guard)
    return joined.withColumn("current_stress", (F.col(value) < F.col("stress_threshold")).cast("int"))


def require(df: DataFrame, column: str) -> DataFrame:
    """The same rows; raises when run if one has no value in the column."""
    guard = F.raise_error(F.lit(f"{column} is missing")).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(F.col(column).isNull(), guard).otherwise(F.col(column)))


def next_step(df: DataFrame, value: str, time: str = "time", partition_by: Sequence[str] = (), calendar: bool = False) -> DataFrame:
    """Adds the next step's flag and value; rows without a next flag go."""
    out = shifted(df, ["current_stress"], -1, "target_stress_next", time, partition_by, calendar)
    out = shifted(out, [value], -1, "{}_next", time, partition_by, calendar)
    return out.na.drop(subset=["target_stress_next"])


def stress_target(df: DataFrame, value: str, train_until: int, q: float = 0.25, time: str = "time", partition_by: Sequence[str] = (), calendar: bool = False) -> DataFrame:
    """Thresholds, flags and targets of a series with ``month``."""
    thresholds = seasonal_threshold(df, value, train_until, q, "month", time, partition_by)
    return next_step(flagged(df, thresholds, value, "month", partition_by), value, time, partition_by, calendar)
