"""Sources of different rhythm on one calendar of ten-day periods.

An observation covers the days from its start to its end: one day, a scene's date, a week, a month.
It is dealt out over the dekads that it overlaps, in proportion to the days in each: a level (a
temperature, an index) as a mean weighted by those days, an amount (rain) as the share that falls
into each.  All sources go through one tagged union and one aggregation, whose partial sums are
made before the shuffle, and the calendar is met last; so a dekad without observations is there, and
what nobody observed stays missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.calendar import dekad


@dataclass(frozen=True)
class Source:
    """A table of observations.

    ``start`` and ``end`` are the first and last day covered, dates or timestamps; without ``end``
    a day each.  ``value`` may be any expression.  ``weight``, if there is one, says how much of the
    observed cell counts (a share of cropland): observations without a positive weight are left
    out.  With ``amount`` the value is a total over its days, and not a level.
    """

    rows: DataFrame
    value: str | Column
    start: str | Column
    end: str | Column | None = None
    weight: str | Column | None = None
    amount: bool = False


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dekad_index(day: Column) -> Column:
    """A number for each dekad, one after the other."""
    return (F.year(day) * 36 + (F.month(day) - 1) * 3 + dekad(day) - 1).cast("int")


def dekad_of(index: Column) -> Column:
    """The first day of a numbered dekad."""
    year, rest = F.floor(index / 36).cast("int"), F.pmod(index, F.lit(36))
    return F.make_date(year, (F.floor(rest / 3) + 1).cast("int"), (F.pmod(rest, F.lit(3)) * 10 + 1).cast("int"))


def spread(source: Source, name: str, by: Sequence[str] = ()) -> DataFrame:
    """A row for each observation and dekad that it overlaps: the keys, ``source``, ``dekad``, ``numerator``, ``denominator``.

    Observations without value, start or end, or that end before they start, are left out; NaN and
    infinite values are missing.  The sum of numerators over that of denominators is the dekad's
    level; an amount has no denominators, and its numerators add up.
    """
    start = _column(source.start).cast("date")
    end = start if source.end is None else _column(source.end).cast("date")
    weight = F.lit(1.0) if source.weight is None else _column(source.weight).cast("double")
    value = _column(source.value).cast("double")
    seen = source.rows.select(*by, value.alias("_value"), start.alias("_start"), end.alias("_end"), weight.alias("_weight"))
    seen = seen.filter((F.abs("_value") < float("inf")) & (F.col("_start") <= F.col("_end")) & (F.col("_weight") > 0) & (F.col("_weight") < float("inf")))
    cut = seen.withColumn("dekad", F.explode(F.sequence(dekad_index(F.col("_start")), dekad_index(F.col("_end")))))
    first = dekad_of(F.col("dekad"))
    last = F.date_sub(dekad_of(F.col("dekad") + 1), 1)
    days = F.date_diff(F.least(F.col("_end"), last), F.greatest(F.col("_start"), first)) + 1
    share = days * F.col("_weight")
    if source.amount:
        share = share / (F.date_diff("_end", "_start") + 1)
    numerator = F.col("_value") * share
    return cut.select(*by, F.lit(name).alias("source"), "dekad", numerator.alias("numerator"), (F.lit(None).cast("double") if source.amount else share.cast("double")).alias("denominator"))


def by_dekad(sources: Mapping[str, Source], by: Sequence[str] = ()) -> DataFrame:
    """One row for each dekad (and key) with an observation: ``time``, the sources as columns, ``n_<source>``.

    ``n_<source>`` counts the observations that reach into the dekad.
    """
    parts = [spread(s, name, by) for name, s in sources.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    made = []
    for name, s in sources.items():
        own = F.col("source") == name
        total = F.sum(F.when(own, F.col("numerator")))
        made.append((total if s.amount else total / F.sum(F.when(own, F.col("denominator")))).alias(name))
        made.append(F.count_if(own).alias(f"n_{name}"))
    return union.groupBy(*by, "dekad").agg(*made).withColumn("time", dekad_of(F.col("dekad"))).drop("dekad")


def aligned(sources: Mapping[str, Source], first: str, last: str, by: Sequence[str] = (), places: DataFrame | None = None) -> DataFrame:
    """Every dekad that begins from ``first`` to ``last``, for every place if there are keys, with the sources side by side.

    ``places`` has the keys; a place without observations has its dekads too.  Values stay null and
    counts are 0 where a source has nothing.
    """
    found = by_dekad(sources, by)
    if by and places is None:
        raise ValueError("keys need a table of places")
    # A row for each dekad, of each place if there are some: the calendar is a list within the row.
    ends = [dekad_index(F.lit(day).cast("date")) for day in (first, last)]
    base = places.select(*by).distinct() if by else found.sparkSession.range(1).select()
    calendar = base.select(*by, F.explode(F.sequence(*ends)).alias("_dekad")).withColumn("time", dekad_of(F.col("_dekad"))).drop("_dekad")
    calendar = calendar.filter(F.col("time").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    out = calendar.join(found, [*by, "time"], "left")
    return out.na.fill(0, [f"n_{name}" for name in sources])
