"""Rasters as tables of tiles, with their metadata beside them.

A tile is a row with the numbers of its cells that have a value, and the values; a window of a
raster is a filter on tile keys that reaches the scan.  Tiles lie in folders by blocks of tiles,
sorted by key within a file, so a window opens only the blocks that it meets and, of their files,
only the row groups with its tiles.  Metadata are one row for each raster: shape, affine transform,
reference system, value for missing cells, type, and tags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells along a tile's side, and tiles along a block's.
TILE, BLOCK = 256, 16

PROFILE = "scene_id string, band string, height int, width int, transform array<double>, crs string, nodata double, dtype string, tags map<string,string>"


def tiled(pixels: DataFrame, tile: int = TILE, keys: Sequence[str] = ("scene_id", "band")) -> DataFrame:
    """``(keys, tile_row, tile_col, cells, values)`` of pixels ``(keys, row, col, value)``.

    Cells are numbered by row within a tile; missing ones are not there.  A tile is one row of at
    most ``tile`` * ``tile`` values.
    """
    at = F.pmod("row", F.lit(tile)) * tile + F.pmod("col", F.lit(tile))
    cell = F.struct(at.cast("int").alias("cell"), F.col("value").cast("double").alias("value"))
    placed = pixels.filter("value is not null").select(*keys, F.floor(F.col("row") / tile).cast("int").alias("tile_row"), F.floor(F.col("col") / tile).cast("int").alias("tile_col"), cell.alias("c"))
    out = placed.groupBy(*keys, "tile_row", "tile_col").agg(F.sort_array(F.collect_list("c")).alias("c"))
    return out.select(*keys, "tile_row", "tile_col", F.col("c.cell").alias("cells"), F.col("c.value").alias("values"))


def write_raster(pixels: DataFrame, profile: DataFrame, path: str, tile: int = TILE, block: int = BLOCK) -> None:
    """Writes pixels ``(scene_id, band, row, col, value)`` as tiles, and their profile with tags.

    The profile has the columns of PROFILE.  Values are written in the profile's type where that is
    ``float32``, and what equals its ``nodata`` is missing.
    """
    about = profile.select("scene_id", "band", "nodata", "dtype")
    value = F.when(F.col("value") != F.coalesce("nodata", F.lit(float("nan"))), F.col("value").cast("double"))
    known = pixels.join(about, ["scene_id", "band"]).withColumn("value", F.when(F.col("dtype") == "float32", value.cast("float").cast("double")).otherwise(value))
    rows = tiled(known.select("scene_id", "band", "row", "col", "value"), tile)
    rows = rows.withColumn("block_row", F.floor(F.col("tile_row") / block).cast("int")).withColumn("block_col", F.floor(F.col("tile_col") / block).cast("int"))
    # Blocks are dealt out; within one, files follow each other by tile, as many as its rows need.
    rows.repartition("block_row", "block_col").sortWithinPartitions("block_row", "block_col", "scene_id", "band", "tile_row", "tile_col").write.mode("overwrite").partitionBy("block_row", "block_col").option("compression", "zstd").parquet(f"{path}/tiles")
    profile.select([f.split()[0] for f in PROFILE.split(", ")]).withColumns({"tile": F.lit(tile), "block": F.lit(block)}).write.mode("overwrite").parquet(f"{path}/profile")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """A row for each raster: the columns of PROFILE, and the sides of its tiles and blocks."""
    return spark.read.schema(f"{PROFILE}, tile int, block int").parquet(f"{path}/profile")


def read_window(spark: SparkSession, path: str, row_off: int, col_off: int, height: int, width: int, where: Column | None = None) -> DataFrame:
    """The pixels of a window, numbered within it: ``(scene_id, band, row, col, value)``.

    ``where`` may choose among ``scene_id`` and ``band``.  Bounds are filters on blocks, which
    choose folders, and on tiles, which choose row groups; cells are cut last.
    """
    sides = read_profile(spark, path).select("tile", "block").first()
    schema = "scene_id string, band string, tile_row int, tile_col int, cells array<int>, values array<double>, block_row int, block_col int"
    tiles = spark.read.schema(schema).parquet(f"{path}/tiles")
    if sides is None or height <= 0 or width <= 0:
        return tiles.select("scene_id", "band", F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), F.lit(None).cast("double").alias("value")).limit(0)
    for axis, off, size in (("row", row_off, height), ("col", col_off, width)):
        first, last = off // sides.tile, (off + size - 1) // sides.tile
        tiles = tiles.filter(F.col(f"block_{axis}").between(first // sides.block, last // sides.block) & F.col(f"tile_{axis}").between(first, last))
    if where is not None:
        tiles = tiles.filter(where)
    each = tiles.select("scene_id", "band", "tile_row", "tile_col", F.explode(F.arrays_zip("cells", "values")).alias("c"))
    row = F.col("tile_row") * sides.tile + F.floor(F.col("c.cells") / sides.tile).cast("int") - row_off
    col = F.col("tile_col") * sides.tile + F.pmod(F.col("c.cells"), F.lit(sides.tile)) - col_off
    cut = each.select("scene_id", "band", row.cast("int").alias("row"), col.cast("int").alias("col"), F.col("c.values").alias("value"))
    return cut.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def window_profile(profile: DataFrame, row_off: int, col_off: int, height: int, width: int) -> DataFrame:
    """The profile of a window: its shape, and the transform moved to its corner."""
    t = [F.get("transform", F.lit(k)) for k in range(6)]
    moved = F.array(t[0], t[1], t[0] * col_off + t[1] * row_off + t[2], t[3], t[4], t[3] * col_off + t[4] * row_off + t[5])
    return profile.withColumns({"height": F.lit(height), "width": F.lit(width), "transform": moved})


def filled(pixels: DataFrame, profile: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Every cell of every raster, missing ones with the profile's ``nodata``.

    The cells of a raster are made row by row, so no raster is one task's.
    """
    rows = profile.select("scene_id", "band", "width", "nodata", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias(row))
    cells = rows.select("scene_id", "band", "nodata", row, F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias(col))
    return cells.join(pixels, ["scene_id", "band", row, col], "left").select("scene_id", "band", row, col, F.coalesce("value", "nodata").alias("value"))
