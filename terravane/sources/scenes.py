"""Catalogues of scenes: (id, datetime, properties map, assets map, and a box)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.geo import boxes_meet


def search(catalogue: DataFrame, box: tuple[float, float, float, float], first: str, last: str) -> DataFrame:
    """Scenes that meet a box (west, south, east, north) within first..last, both days included."""
    sides = ("west", "south", "east", "north")
    near = boxes_meet({s: F.col(s) for s in sides}, {s: F.lit(float(v)) for s, v in zip(sides, box, strict=True)})
    days = (F.col("datetime") >= F.lit(first).cast("date")) & (F.col("datetime") < F.date_add(F.lit(last).cast("date"), 1))
    return catalogue.filter(near & days)


def widened(catalogue: DataFrame, box: tuple[float, float, float, float], ranges: Sequence[tuple[str, str]]) -> DataFrame:
    """How many scenes each of several date ranges has: none in a narrow one does not mean none at all."""
    counts = None
    for first, last in ranges:
        found = search(catalogue, box, first, last).agg(F.count("*").alias("scenes")).select(F.lit(f"{first}/{last}").alias("range"), "scenes")
        counts = found if counts is None else counts.union(found)
    return counts


def with_assets(scenes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Scenes that have all the assets; others are left out."""
    wanted = F.lit(True)
    for name in names:
        wanted &= F.map_contains_key("assets", name)
    return scenes.filter(F.coalesce(wanted, F.lit(False)))


def requiring_assets(scenes: DataFrame, names: Sequence[str]) -> DataFrame:
    """All scenes; raises when run if one lacks an asset."""
    missing = F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce(F.map_keys("assets"), F.array().cast("array<string>")))
    message = F.concat(F.lit("assets missing: "), F.array_join(missing, ", "))
    return scenes.withColumn("id", F.when(F.size(missing) > 0, F.raise_error(message)).otherwise(F.col("id")))


def by_id(scenes: DataFrame, scene: str) -> DataFrame:
    """One scene; raises at once if there is none."""
    found = scenes.filter(F.col("id") == scene).limit(1)
    if found.isEmpty():
        raise LookupError(f"no scene {scene}")
    return found


def cloud_cover(scenes: DataFrame, key: str = "eo:cloud_cover") -> DataFrame:
    """Adds a property as a number, null where it is absent."""
    return scenes.withColumn("cloud_cover", F.try_element_at("properties", F.lit(key)).cast("double"))
