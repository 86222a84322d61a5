"""Time series: aggregation to periods, lags, cyclic features and complete rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from terravane.functions.calendar import cycle, month_of, month_start


def in_order(time: str, partition_by: Sequence[str] = ()) -> WindowSpec:
    """Positional order.  Without partitions all rows meet in one task, so aggregate to periods first."""
    return (Window.partitionBy(*partition_by) if partition_by else Window.partitionBy(F.lit(0))).orderBy(time)


def monthly(df: DataFrame, time: str, measures: dict[str, Column], partition_by: Sequence[str] = ()) -> DataFrame:
    """One row for each month (and partition) with aggregates of its rows; an empty sum stays null."""
    keys = [F.col(c) for c in partition_by]
    return df.groupBy(*keys, month_start(F.col(time)).alias("time")).agg(*[c.alias(k) for k, c in measures.items()])


def shifted(df: DataFrame, columns: Sequence[str], steps: int, name: str, time: str = "time", partition_by: Sequence[str] = (), calendar: bool = False) -> DataFrame:
    """Adds ``name.format(column)``: the value ``steps`` periods before (negative: after) each row.

    By default steps are positions, whatever the gaps.  With ``calendar`` they are months, found by
    a join on the month, so a gap gives null.
    """
    if not calendar:
        window = in_order(time, partition_by)
        return df.withColumns({name.format(c): F.lag(c, steps).over(window) for c in columns})
    other = df.select(*partition_by, F.add_months(time, steps).alias(time), *[F.col(c).alias(name.format(c)) for c in columns])
    return df.join(other, [*partition_by, time], "left")


def with_cycle(df: DataFrame, month: str = "month") -> DataFrame:
    sine, cosine = cycle(F.col(month))
    return df.withColumns({"month_sin": sine, "month_cos": cosine})


def with_calendar(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns({"year": F.year(time).cast("int"), "month": month_of(F.col(time))})


def lagged_features(df: DataFrame, columns: Sequence[str], time: str = "time", partition_by: Sequence[str] = (), calendar: bool = False) -> DataFrame:
    """Values of the step before and the seasonal cycle; rows with any null go."""
    return with_cycle(shifted(df, columns, 1, "{}_lag1", time, partition_by, calendar)).na.drop("any")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating-point columns, so that it counts as missing everywhere."""
    floating = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(dict(df.dtypes)[c])).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns])


def drop_all_missing(df: DataFrame) -> DataFrame:
    """Without the columns that hold nothing but nulls."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])


def missing_report(df: DataFrame) -> DataFrame:
    """For each column: rows, values, and whether it holds nothing."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"v_{i}") for i, c in enumerate(df.columns)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows").alias("rows"), F.col(f"v_{i}").alias("present")) for i, c in enumerate(df.columns)])
    return counts.select(F.explode(entries).alias("e")).select("e.*").withColumn("all_missing", F.col("present") == 0)


def merged(tables: Sequence[DataFrame], on: str | list[str] = "time") -> DataFrame:
    """Inner 1:1 merge of sources on their period."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, on)
    return out


def stacked(tables: dict[str, DataFrame], provenance: str = "source_file") -> DataFrame:
    """Sources one below the other, each row with its source's name; absent columns are null."""
    out = None
    for name, t in tables.items():
        t = t.withColumn(provenance, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
