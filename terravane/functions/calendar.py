"""Calendar keys, ten-day periods and the seasonal cycle, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_start(time: Column) -> Column:
    """The first day of the month, as a date."""
    return F.trunc(time, "month")


def year_of(time: Column) -> Column:
    return F.year(time).cast("int")


def month_of(time: Column) -> Column:
    return F.month(time).cast("int")


def in_years(time: Column, first: int | None = None, last: int | None = None) -> Column:
    """Whether a time lies in the years first..last; plain comparisons, so that scans can use them."""
    out = time.isNotNull()
    if first is not None:
        out &= time >= F.lit(f"{first:04d}-01-01").cast("date")
    if last is not None:
        out &= time < F.lit(f"{last + 1:04d}-01-01").cast("date")
    return out


def cycle(month: Column, period: int = 12) -> tuple[Column, Column]:
    """Sine and cosine of the position within a yearly cycle."""
    angle = F.lit(2.0) * F.pi() * month / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def dekad(time: Column) -> Column:
    """1 for days 1-10, 2 for 11-20, 3 for the rest of the month."""
    return (F.least(F.floor((F.day(time) - 1) / 10), F.lit(2)) + 1).cast("int")


def dekad_start(time: Column) -> Column:
    return F.date_add(month_start(time), (dekad(time) - 1) * 10)


def dekad_days(time: Column) -> Column:
    """Length of the time's dekad: 10, 10, and 8 to 11 days."""
    return F.when(dekad(time) < 3, F.lit(10)).otherwise(F.day(F.last_day(time)) - 20).cast("int")


def per_dekad(daily: Column, time: Column) -> Column:
    """A rate per day as an amount per dekad."""
    return daily * dekad_days(time)


def decode(raw: Column, scale: float, offset: float = 0.0, nodata: float | None = None) -> Column:
    """raw * scale + offset, null where the raw value says that there is none."""
    value = raw.cast("double") * F.lit(float(scale)) + F.lit(float(offset))
    return value if nodata is None else F.when(raw != F.lit(nodata), value)


def month_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """All months from first to last, as ``time``."""
    days = F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.trunc(F.lit(last).cast("date"), "month"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(days).alias("time"))


def dekad_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """All dekads that begin from first to last, as ``time``."""
    starts = month_spine(spark, first, last).select(F.explode(F.transform(F.array(F.lit(0), F.lit(10), F.lit(20)), lambda d: F.date_add("time", d))).alias("time"))
    return starts.filter(F.col("time").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
