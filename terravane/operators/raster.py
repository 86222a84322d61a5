"""Rasters as long tables of pixels: (scene, row, col, value).

Missing pixels are null.  Resampling generates the source neighbours of each target pixel and
meets them in an equi-join on whole numbers.  ``bilinear`` has four neighbours at any scale;
``smoothed`` widens the kernel when the target grid is coarser, and scatters each source pixel to
the target pixels whose kernel reaches it, which is one aggregation and no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions.geo import from_utm, to_utm
from terravane.operators.quantile import exact_quantiles

# Classes of the scene classification that spoil a pixel, and the value written for missing ones.
BAD_CLASSES = (0, 1, 3, 8, 9, 10, 11)
NODATA = -9999.0


def finite(value: Column) -> Column:
    """Whether a value is a number: not null, NaN, which Spark orders last, or infinite.

    It names the value once: filters are pushed below what makes a value, and every mention then computes it anew.
    """
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def clear(quality: Column, bad: Sequence[int] = BAD_CLASSES) -> Column:
    """Whether a pixel's class does not spoil it; a pixel without class is spoilt."""
    return F.coalesce(~quality.isin(*bad), F.lit(False))


def normalised_difference(a: Column, b: Column, usable: Column | None = None) -> Column:
    """(a - b) / (a + b) in single precision; null where unusable, not finite, or the sum is 0."""
    good = finite(a) & finite(b) & ((a + b) != 0)
    return F.when(good if usable is None else good & usable, ((a - b) / (a + b)).cast("float"))


def in_range(df: DataFrame, value: str, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Drops values outside the physical range, bounds included in it."""
    return df.filter(F.col(value).between(low, high))


def guarded(df: DataFrame, value: str, low: float = -1.01, high: float = 1.01) -> DataFrame:
    """The same rows; raises when run if a value lies outside the tolerant range."""
    bad = (F.col(value) < low) | (F.col(value) > high)
    message = F.concat(F.lit(f"{value} out of range: "), F.col(value).cast("string"))
    return df.withColumn(value, F.when(bad, F.raise_error(message).cast(df.schema[value].dataType)).otherwise(F.col(value)))


def composite(df: DataFrame, value: str = "value", keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Mean over scenes and number of scenes with a value, for each pixel."""
    return df.groupBy(*keys).agg(F.avg(value).alias("value"), F.count(value).alias("scenes"))


def coverage(grid: DataFrame, composed: DataFrame, keys: Sequence[str] = ("row", "col"), by: Sequence[str] = ()) -> DataFrame:
    """Covered cells, all cells of the grid and their ratio; uncovered cells count in the denominator."""
    joined = grid.join(composed, list(keys), "left")
    return joined.groupBy(*by).agg(F.count("value").alias("covered"), F.count("*").alias("cells"), F.try_divide(F.count("value").cast("double"), F.count("*")).alias("fraction"))


def weighted_summary(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted and plain mean, exact median, extremes and counts of pixels with positive weight."""
    used = df.filter(finite(F.col(value)) & (F.col(weight) > 0)).withColumn("_group", F.struct(F.lit(0).alias("_"), *by))
    facts = used.groupBy("_group").agg(
        F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted_mean"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count("*").alias("pixels"),
        F.sum(weight).alias("weight"),
    )
    median = exact_quantiles(used, value, [0.5], ["_group"]).select("_group", F.col("value").alias("median"))
    return facts.join(median, "_group").select(*[F.col("_group")[c].alias(c) for c in by], "weighted_mean", "mean", "median", "min", "max", "pixels", "weight")


def fractional_cover(df: DataFrame, flag: Column, block: int, row: str = "row", col: str = "col") -> DataFrame:
    """Share of flagged pixels in each block of a coarser grid."""
    coarse = [F.floor(F.col(c) / block).cast("int").alias(c) for c in (row, col)]
    return df.groupBy(*coarse).agg(F.avg(flag.cast("double")).alias("fraction"))


def windowed(df: DataFrame, row_off: int, col_off: int, height: int, width: int) -> DataFrame:
    """The pixels of a window, numbered within it; the bounds are plain filters that prune scans."""
    inside = F.col("row").between(row_off, row_off + height - 1) & F.col("col").between(col_off, col_off + width - 1)
    return df.filter(inside).withColumn("row", F.col("row") - row_off).withColumn("col", F.col("col") - col_off)


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """All cells of a grid."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def _source(index: Column, scale: float, shift: float) -> Column:
    """Where the centre of a target cell lies in source cells, counted from the first one's centre."""
    return (index + 0.5) * scale + shift - 0.5


def nearest(source: DataFrame, target: DataFrame, scale: float = 1.0, shift: tuple[float, float] = (0.0, 0.0), keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Values of the source cells that hold the centres of the target cells; ``scale`` source cells make a target cell."""
    return nearest_at(source, target.withColumn("y", _source(F.col("row"), scale, shift[0])).withColumn("x", _source(F.col("col"), scale, shift[1])), keys)


def nearest_at(source: DataFrame, placed: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Values of the source cells that hold the places ``y``, ``x`` of target cells, counted from the first source cell's centre."""
    wanted = placed.select("row", "col", F.floor(F.col("y") + 0.5).cast("int").alias("sr"), F.floor(F.col("x") + 0.5).cast("int").alias("sc"))
    pixels = source.select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    return wanted.join(pixels, ["sr", "sc"]).select(*keys, "row", "col", "value")


def bilinear(source: DataFrame, target: DataFrame, scale: float = 1.0, shift: tuple[float, float] = (0.0, 0.0), keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Values between the four source cells around each target cell's centre.

    Missing neighbours are left out and the others' weights enlarged; a cell without any has no row.
    """
    return bilinear_at(source, target.withColumn("y", _source(F.col("row"), scale, shift[0])).withColumn("x", _source(F.col("col"), scale, shift[1])), keys)


def bilinear_at(source: DataFrame, placed: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """``bilinear`` for target cells with places ``y``, ``x`` of their own, counted from the first source cell's centre."""
    corners = [
        F.struct((F.floor("y") + i).cast("int").alias("sr"), (F.floor("x") + j).cast("int").alias("sc"), ((F.col("y") - F.floor("y") if i else 1 - (F.col("y") - F.floor("y"))) * (F.col("x") - F.floor("x") if j else 1 - (F.col("x") - F.floor("x")))).alias("w"))
        for i in (0, 1)
        for j in (0, 1)
    ]
    wanted = placed.select("row", "col", F.explode(F.array(*corners)).alias("n")).select("row", "col", "n.*").filter("w > 0")
    pixels = source.select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    met = wanted.join(pixels, ["sr", "sc"]).filter("value is not null")
    return met.groupBy(*keys, "row", "col").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))


def smoothed(source: DataFrame, height: int, width: int, scale: float = 1.0, shift: tuple[float, float] = (0.0, 0.0), keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Bilinear values with a kernel as wide as the coarser grid's cells, on a target grid of ``height`` x ``width``.

    The kernel is a triangle in each direction, from the target cell's centre to one target cell on
    either side, or one source cell if those are larger (then this is ``bilinear``).  ``scale``
    source cells make a target cell, ``shift`` is where the target's corner lies in source cells.
    See ``scattered`` for missing values.
    """
    placed = source.withColumn("y", (F.col("row") + 0.5 - shift[0]) / scale - 0.5).withColumn("x", (F.col("col") + 0.5 - shift[1]) / scale - 0.5)
    return scattered(placed, height, width, max(1.0, 1.0 / scale), keys)


def scattered(placed: DataFrame, height: int, width: int, reach: float = 1.0, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Weighted means on a grid of the values of source cells with places ``y``, ``x`` in target cells.

    Places are counted from the first target cell's centre.  A value counts for every target cell
    within ``reach`` of its place, with a weight that falls from there to nothing in either
    direction; what rounding leaves of a weight of nothing, below 1e-12, is nothing.  Missing values
    are left out and the others' weights enlarged; a cell without any has no row.  A mean lies between the values it is of, whatever the rounding, so a constant field stays one.
    Partial sums are made before the shuffle: a source cell adds to 4 target cells, if those are the larger ones.
    """

    def near(place: str, size: int) -> Column:
        """The target cells of one direction, with their weights."""
        first, last = F.greatest(F.floor(F.col(place) - reach) + 1, F.lit(0)), F.least(F.ceil(F.col(place) + reach) - 1, F.lit(size - 1))
        cells = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(cells, lambda t: F.struct(t.cast("int").alias("at"), (F.lit(1.0) - F.abs(t - F.col(place)) / reach).alias("w")))

    used = placed.filter(finite(F.col("value")) & F.col("y").isNotNull() & F.col("x").isNotNull())
    rows = used.select(*keys, F.col("value").cast("double").alias("v"), near("x", width).alias("across"), F.explode(near("y", height)).alias("down"))
    cells = rows.select(*keys, "v", "down", F.explode("across").alias("across"))
    weighted = cells.select(*keys, F.col("down.at").alias("row"), F.col("across.at").alias("col"), "v", (F.col("down.w") * F.col("across.w")).alias("w")).filter("w > 1e-12")
    mean = F.greatest(F.min("v"), F.least(F.max("v"), F.sum(F.col("v") * F.col("w")) / F.sum("w")))
    return weighted.groupBy(*keys, "row", "col").agg(mean.alias("value"))


def reshaped(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """An array column as pixels of a raster for each row."""
    each = df.select(F.col(key).alias("scene_id"), F.posexplode(values).alias("k", "value"))
    return each.select("scene_id", F.floor(F.col("k") / width).cast("int").alias("row"), (F.col("k") % width).cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def masked_in_range(df: DataFrame, value: str, nodata: float | None) -> DataFrame:
    """The nodata value becomes null."""
    return df.withColumn(value, F.when(F.col(value) != F.lit(nodata), F.col(value)))


def encoded(value: Column, nodata: float = NODATA) -> Column:
    """Values that are no numbers become the nodata value."""
    return F.when(finite(value), value).otherwise(F.lit(nodata))


def reprojected(source: DataFrame, target: DataFrame, zone: int, west: float, north: float, size: float, smooth: bool = True, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """A raster in metres of a UTM zone on target cells ``(row, col, longitude, latitude)`` given in degrees.

    ``west`` and ``north`` are the source's corner and ``size`` its cells' side.  Each target
    cell's centre is projected, and takes the value between the four source cells around it, or
    with ``smooth`` off that of the cell that holds it; cells beyond the source have no row.
    """
    east, up = to_utm(F.col("longitude"), F.col("latitude"), zone)
    placed = target.select("row", "col", ((F.lit(float(north)) - up) / size - 0.5).alias("y"), ((east - west) / size - 0.5).alias("x"))
    return (bilinear_at if smooth else nearest_at)(source, placed, keys)


def reprojected_smoothed(source: DataFrame, zone: int, corner: tuple[float, float], size: float, target: tuple[float, float], step: tuple[float, float], height: int, width: int, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """A raster in metres of a UTM zone on a coarser grid in degrees, each source cell scattered to the targets around it.

    ``corner`` is the source's west and north in metres and ``size`` its cells' side; ``target``
    the grid's west and north in degrees and ``step`` its cells' width and height.
    """
    east, north = corner[0] + (F.col("col") + 0.5) * size, corner[1] - (F.col("row") + 0.5) * size
    longitude, latitude = from_utm(east, north, zone)
    placed = source.withColumn("x", (longitude - target[0]) / step[0] - 0.5).withColumn("y", (F.lit(target[1]) - latitude) / step[1] - 0.5)
    return scattered(placed, height, width, 1.0, keys)


def same_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(same)``: whether two grids have the same cells, holes included."""
    sides = [t.select("row", "col", F.lit(1).alias(n)) for t, n in ((a, "_a"), (b, "_b"))]
    joined = sides[0].join(sides[1], ["row", "col"], "full_outer")
    return joined.agg((F.count_if(F.col("_a").isNull() | F.col("_b").isNull()) == 0).alias("same"))


def masked_mosaic(mosaic: DataFrame, mask: DataFrame, value: str = "value", cover: str = "fraction") -> DataFrame:
    """A mosaic's cells with the cover of a mask on the same grid: ``(row, col, value, cover)``.

    Raises at once if the mosaic has no cell, and when run if a cell is on one of the grids only.
    """
    if mosaic.isEmpty():
        raise ValueError("the mosaic is empty")
    sides = [t.select("row", "col", F.col(c).alias(c), F.lit(True).alias(n)) for t, c, n in ((mosaic, value, "_a"), (mask, cover, "_b"))]
    both = sides[0].join(sides[1], ["row", "col"], "full_outer")
    message = F.concat_ws(" ", F.lit("not on both grids:"), "row", "col")
    row = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(message).cast("int")).otherwise(F.col("row"))
    return both.select(row.alias("row"), "col", value, cover)


def metadata(df: DataFrame, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Shape and extent of each raster's pixels, and how many of them have a value."""
    return df.groupBy(*by).agg(
        F.min("row").alias("first_row"),
        F.min("col").alias("first_col"),
        (F.max("row") - F.min("row") + 1).alias("height"),
        (F.max("col") - F.min("col") + 1).alias("width"),
        F.count("*").alias("cells"),
        F.count("value").alias("valid"),
    )


def banded(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("scene_id", "row", "col")) -> DataFrame:
    """Long pixels (keys, band, value) with a column for each band; one pass, one shuffle."""
    return pixels.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])


def vegetation_composite(pixels: DataFrame, target: DataFrame, red: str = "red", nir: str = "nir", quality: str = "scl", bad: Sequence[int] = BAD_CLASSES) -> DataFrame:
    """Mean index over all scenes on the target's cells, with the number of clear scenes; uncovered cells are null.

    Scenes that lack a band have no complete pixels and so contribute nothing.
    """
    wide = banded(pixels, [red, nir, quality])
    wide = wide.withColumn("value", normalised_difference(F.col(nir).cast("float"), F.col(red).cast("float"), clear(F.col(quality).cast("int"), bad)))
    composed = composite(in_range(wide, "value"))
    return target.join(composed, ["row", "col"], "left").withColumn("scenes", F.coalesce("scenes", F.lit(0)))


def region_mean(df: DataFrame, value: str, box: tuple[float, float, float, float], longitude: str = "longitude", latitude: str = "latitude", by: Sequence[str] = ()) -> DataFrame:
    """Mean of the cells whose centre lies in a box (west, south, east, north), borders included."""
    west, south, east, north = box
    inside = F.col(longitude).between(west, east) & F.col(latitude).between(south, north)
    return df.filter(inside).groupBy(*by).agg(F.avg(value).alias(value), F.count(value).alias("cells"))
