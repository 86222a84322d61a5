"""Chronological splits and the checks that nothing leaks across them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions.calendar import in_years, year_of

SPLITS = ("train", "validation", "test")
#: Ranges of an ordinal within which rows are ordered.
BINS = 1024


def chronological(df: DataFrame, train_until: int, time: str = "time", embargo: int = 0) -> DataFrame:
    """Adds ``split``: years up to ``train_until``, the year after it, and the one after that; later rows go.

    The split follows the feature's month.  The last months of a split have targets from the next
    one; ``embargo`` drops so many of them.
    """
    t = F.col(time)
    year = year_of(t)
    split = F.when(year <= train_until, "train").when(year == train_until + 1, "validation").when(year == train_until + 2, "test")
    out = df.filter(in_years(t, last=train_until + 2)).withColumn("split", split)
    if embargo:
        edge = F.when(F.col("split") == "train", train_until + 1).when(F.col("split") == "validation", train_until + 2)
        out = out.filter(edge.isNull() | (t < F.add_months(F.make_date(edge, F.lit(1), F.lit(1)), -embargo)))
    return out


def bounds(df: DataFrame, time: str = "time") -> DataFrame:
    return df.groupBy("split").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("rows"))


def rolling_origin(df: DataFrame, first: int, last: int, time: str = "time") -> DataFrame:
    """Folds by test year: all earlier years train, with ``fold`` and ``role``.

    The folds are a constant number of copies, made by one pass over the rows.
    """
    year = year_of(F.col(time))
    folds = F.sequence(F.greatest(F.lit(first), year), F.lit(last))
    out = df.filter(in_years(F.col(time), last=last)).withColumn("fold", F.explode(folds))
    return out.withColumn("role", F.when(year < F.col("fold"), "train").otherwise("test"))


def _steps(df: DataFrame, time: str, ordinal: str, partition_by: Sequence[str]) -> DataFrame:
    """``ok``: whether rows do not go back in time, by ordinal; rows with equal ordinals are in the order of time.

    Rows without an ordinal have no place and are left out.  Whole numbers stay whole: ranges of
    the ordinal are cut by division without remainder, other numbers by their double, and rows are
    ordered by the ordinal itself.
    """
    kind = df.schema[ordinal].dataType.typeName()
    place = {"date": F.unix_date, "timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp"))}.get(kind, lambda c: c)(F.col(ordinal))
    whole = kind in ("date", "timestamp", "timestamp_ntz", "byte", "short", "integer", "long")
    coarse = place.cast("long" if whole else "double")
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(partition_by)], place.alias("_at"), coarse.alias("_coarse"), F.col(time).alias("_time")).filter("_at is not null")
    keys = [f"_k{i}" for i in range(len(partition_by))]
    # One row: the ordinal's range.
    ends = F.broadcast(rows.agg(F.min("_coarse").alias("_low"), F.max("_coarse").alias("_high")))
    if whole:
        bin_ = F.expr(f"_coarse div (_high div {BINS} - _low div {BINS} + 1)")
    else:
        bin_ = F.floor((F.col("_coarse") - F.col("_low")) / (F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300)) / BINS))
    rows = rows.join(ends).withColumn("_bin", bin_).drop("_low", "_high")
    inside = rows.select((F.col("_time") >= F.lag("_time").over(Window.partitionBy(*keys, "_bin").orderBy("_at", "_time"))).alias("ok"))
    bins = rows.groupBy(*keys, "_bin").agg(F.min(F.struct("_at", "_time")).alias("_first"), F.max(F.struct("_at", "_time")).alias("_last"))
    before = F.lag("_last._time").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bin"))
    return inside.union(bins.select((F.col("_first._time") >= before).alias("ok")))


def leakage_report(df: DataFrame, features: Sequence[str], forbidden: Sequence[str], time: str = "time", ordinal: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """``(check, passed)``: unique times, order, no forbidden features, splits one after the other.

    ``features`` must be the list the model is given.  Order is checked against ``ordinal`` if
    there is one (a number, date or timestamp), as a table has none of its own: neighbours by
    ordinal may not go back in time.  That is checked within BINS ranges of the ordinal, and then
    between the last of each range and the first of the next one.
    The checks on ``split`` are made if there is such a column.
    """
    spark = df.sparkSession
    unique = df.groupBy(*partition_by, time).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("passed"))
    checks = [unique.select(F.lit("unique_time").alias("check"), "passed")]
    if ordinal:
        steps = _steps(df, time, ordinal, partition_by)
        checks.append(steps.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed")).select(F.lit("monotonic_time").alias("check"), "passed"))
    clash = sorted(set(features) & set(forbidden))
    checks.append(spark.range(1).select(F.lit("no_forbidden_feature").alias("check"), F.lit(not clash).alias("passed")))
    if "split" in df.columns:
        ends = df.agg(*[f(F.when(F.col("split") == s, F.col(time))).alias(f"{n}_{s}") for s in SPLITS for n, f in (("min", F.min), ("max", F.max))])
        for a, b in (SPLITS[:2], SPLITS[1:]):
            checks.append(ends.select(F.lit(f"{a}_before_{b}").alias("check"), (F.col(f"max_{a}") < F.col(f"min_{b}")).alias("passed")))
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out
