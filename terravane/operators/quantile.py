"""Exact quantiles of groups of any size, by refinement.

A quantile lies between two neighbours in the order of a group's values, so two ranks are wanted.
Each round sketches every group, in summaries of bounded size that merge, for GRID + 1 of its
quantiles, and brackets the ranks by a few of them.  A pass counts what lies below and inside the
bracket, which settles where the ranks are whatever the sketch said, and the values inside go on,
with the ranks lowered by what lies below.  That goes on until no group keeps more than LEAF
different values; only those are ordered.  Brackets follow ranks, not widths, so outliers do not
widen them, and ties count as one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.sources.tables import scratch

#: Steps of a sketch, its accuracy, and the different values of a group that one task orders.
GRID, ACCURACY, LEAF = 256, 10_000, 100_000
#: Brackets that are sent to all tasks; more of them meet the values in a sorted join.
FEW = 50_000


def beside(values: DataFrame, small: DataFrame, on: Sequence[str], few: bool) -> DataFrame:
    """Values with a row for each of their groups; never are the values sent to all, however small their files."""
    return values.join(F.broadcast(small) if few else small.hint("merge"), list(on))


def exact_quantiles(df: DataFrame, value: str, levels: Sequence[float], by: Sequence[str] = (), grid: int = GRID, leaf: int = LEAF) -> DataFrame:
    """``by``, ``level``, ``value`` and ``n``: exact quantiles with linear interpolation between ranks.

    Nulls, NaN and infinite values do not count; a group without others has no rows.  Null keys are
    keys.  The table is read three times in the first round; later rounds read a small part of it,
    which is written to the shared folder.  Levels share the first sketch.
    """
    left = df.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(value).cast("double").alias("v")).filter(F.abs("v") < float("inf"))
    folder = scratch(df.sparkSession)

    def written(t: DataFrame, name: str) -> DataFrame:
        t.write.parquet(f"{folder}/{name}")
        return t.sparkSession.read.schema(t.schema).parquet(f"{folder}/{name}")

    # Values have no level until brackets tell them apart.
    group, on = ["g", "k"], ["g"]
    sketch = F.percentile_approx("v", [j / grid for j in range(grid + 1)], ACCURACY)
    each = F.explode(F.array(*[F.lit(k) for k in range(len(levels))])).alias("k")
    whole = written(left.groupBy("g").agg(F.count("*").alias("n"), sketch.alias("p")), "sketch-0")
    sketched = whole.select("g", each, "n", "p")
    at = F.element_at(F.array(*[F.lit(float(q)) for q in levels]), F.col("k") + 1) * (F.col("n") - 1)
    ranks = whole.select("g", each, "n").select(*group, F.col("n").alias("whole"), F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part"))
    most, groups = whole.agg(F.max("n"), F.count("*")).first()
    largest, few, rounds = most or 0, groups * len(levels) <= FEW, 0
    while largest > leaf:
        ranks, left = narrowed(left, sketched, ranks, grid, on, few)
        ranks, left, rounds, on = written(ranks, f"ranks-{rounds}"), written(left, f"values-{rounds}"), rounds + 1, group
        different = left.groupBy(*group, "v").agg(F.lit(1).alias("one")).groupBy(*group).agg(F.count("*").alias("n"))
        largest = different.agg(F.max("n")).first()[0] or 0
        if largest > leaf:
            sketched = written(left.groupBy(*group).agg(F.count("*").alias("n"), sketch.alias("p")), f"sketch-{rounds}")
    upto = Window.partitionBy(*on).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = beside(left.groupBy(*on, "v").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(upto)), ranks, on, few)
    holds = [F.min(F.when(F.col("end") > F.col(rank), F.col("v"))) for rank in ("low", "high")]
    out = placed.groupBy(*group, "part", "whole").agg(holds[0].alias("a"), holds[1].alias("b"))
    level = F.element_at(F.array(*[F.lit(float(q)) for q in levels]), F.col("k") + 1)
    # Where both ranks hold the same value, that is the quantile, without rounding.
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return out.select(*[F.col("g")[c].alias(c) for c in by], level.alias("level"), between.alias("value"), F.col("whole").alias("n"))


def narrowed(left: DataFrame, sketched: DataFrame, ranks: DataFrame, grid: int, on: Sequence[str] = ("g", "k"), few: bool = True) -> tuple[DataFrame, DataFrame]:
    """The ranks within brackets, and the values in the brackets; see the module.

    ``left`` has (g, k, v), ``sketched`` the number and quantiles of each group, ``ranks`` its ranks.
    With ``on`` of g alone, ``left`` has (g, v), and a value is in the brackets of every k.  ``few``
    says that the brackets may be sent to all tasks.
    """
    group = ["g", "k"]
    below, above = F.floor(F.col("low") / F.col("n") * grid) - 1, F.ceil((F.col("high") + 1) / F.col("n") * grid) + 1
    infinity = F.lit(float("inf"))
    edges = beside(sketched, ranks, group, few).select(*ranks.columns, F.coalesce(F.get("p", below.cast("int")), -infinity).alias("lo"), F.coalesce(F.get("p", above.cast("int")), infinity).alias("hi"))
    counts = beside(left, edges.select(*group, "lo", "hi"), on, few).groupBy(*group).agg(F.count_if(F.col("v") < F.col("lo")).alias("under"), F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("inside"))
    known = beside(edges, counts, group, few)
    # A bracket that misses a rank is opened on that side.
    lo = F.when(F.col("low") >= F.col("under"), F.col("lo")).otherwise(-infinity)
    hi = F.when(F.col("high") < F.col("under") + F.col("inside"), F.col("hi")).otherwise(infinity)
    off = F.when(F.col("low") >= F.col("under"), F.col("under")).otherwise(0)
    found = known.select(*group, "whole", (F.col("low") - off).alias("low"), (F.col("high") - off).alias("high"), "part", lo.alias("lo"), hi.alias("hi"))
    kept = beside(left, found.select(*group, "lo", "hi"), on, few).filter(F.col("v").between(F.col("lo"), F.col("hi"))).select(*group, "v")
    return found.drop("lo", "hi"), kept
