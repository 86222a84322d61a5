import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import raster


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_index_masks_and_guards(spark):
    rows = frame(spark, [(0.2, 0.6, 4), (0.5, -0.5, 4), (0.2, 0.6, 8), (0.2, 0.6, None), (float("nan"), 0.6, 4), (None, 0.6, 4), (-0.1, 0.3, 4)], "red float, nir float, scl int")
    value = raster.normalised_difference(F.col("nir"), F.col("red"), raster.clear(F.col("scl")))
    got = [r[0] for r in rows.select(value).collect()]
    want = np.float32(np.float32(0.6) - np.float32(0.2)) / np.float32(np.float32(0.6) + np.float32(0.2))
    assert got[0] == pytest.approx(float(want)) and got[1:6] == [None] * 5 and got[6] > 1
    kept = raster.in_range(rows.withColumn("v", value), "v")
    assert kept.count() == 1


def test_float32_equals_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random(500, dtype=np.float32), rng.random(500, dtype=np.float32)
    rows = frame(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a float, b float")
    got = [r[1] for r in rows.select("i", raster.normalised_difference(F.col("a"), F.col("b"))).orderBy("i").collect()]
    assert np.array_equal(np.array(got, dtype=np.float32), (a - b) / (a + b))


def test_guard_raises_only_beyond_tolerance(spark):
    ok = frame(spark, [(1.005,), (-1.0,), (None,)], "v double")
    assert raster.guarded(ok, "v").count() == 3
    with pytest.raises(Exception, match="out of range"):
        raster.guarded(frame(spark, [(1.2,)], "v double"), "v").collect()


def test_composite_coverage_and_weights(spark):
    rows = frame(spark, [(1, 0, 0, 0.2), (2, 0, 0, 0.4), (1, 0, 1, None), (2, 1, 1, 0.9)], "scene int, row int, col int, value double")
    composed = raster.composite(rows)
    got = {(r.row, r.col): (r.value, r.scenes) for r in composed.collect()}
    assert got[(0, 0)] == (pytest.approx(0.3), 2) and got[(0, 1)] == (None, 0)
    cover = raster.coverage(raster.grid(spark, 2, 2), composed).first()
    assert (cover.covered, cover.cells, cover.fraction) == (2, 4, 0.5)
    weighted = frame(spark, [(0.2, 1.0), (0.8, 3.0), (0.5, 0.0), (float("nan"), 2.0), (None, 2.0)], "v double, w double")
    r = raster.weighted_summary(weighted, "v", "w").first()
    assert (r.weighted_mean, r.mean, r.median, r.min, r.max, r.pixels, r.weight) == (pytest.approx(0.65), 0.5, 0.5, 0.2, 0.8, 2, 4.0)


def test_bilinear_equals_numpy(spark):
    rng = np.random.default_rng(1)
    image = rng.random((6, 7))
    source = frame(spark, [(1, r, c, float(image[r, c])) for r in range(6) for c in range(7)], "scene_id int, row int, col int, value double")
    scale, shift = 1.3, (0.4, 0.2)
    got = {(r.row, r.col): r.value for r in raster.bilinear(source, raster.grid(spark, 4, 4), scale, shift).collect()}
    for i in range(4):
        for j in range(4):
            y, x = (i + 0.5) * scale + shift[0] - 0.5, (j + 0.5) * scale + shift[1] - 0.5
            total = weight = 0.0
            for a in (math.floor(y), math.floor(y) + 1):
                for b in (math.floor(x), math.floor(x) + 1):
                    w = (1 - abs(y - a)) * (1 - abs(x - b))
                    if w > 0 and 0 <= a < 6 and 0 <= b < 7:
                        total, weight = total + w * image[a, b], weight + w
            assert got[(i, j)] == pytest.approx(total / weight, abs=1e-12)


def test_nearest_window_and_nodata(spark):
    source = frame(spark, [(1, r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "scene_id int, row int, col int, value double")
    got = {(r.row, r.col): r.value for r in raster.nearest(source, raster.grid(spark, 2, 2), 2.0).collect()}
    assert got == {(0, 0): 11.0, (0, 1): 13.0, (1, 0): 31.0, (1, 1): 33.0}
    part = {(r.row, r.col): r.value for r in raster.windowed(source, 1, 2, 2, 2).collect()}
    assert part == {(0, 0): 12.0, (0, 1): 13.0, (1, 0): 22.0, (1, 1): 23.0}
    assert raster.same_grid(source, source.withColumn("value", F.lit(0))).first().same
    assert not raster.same_grid(source, source.filter("row < 3")).first().same
    # Holes in different places: counts and extremes are the same.
    holes = [source.filter(f"not (row = 1 and col = {c})") for c in (1, 2)]
    assert not raster.same_grid(*holes).first().same
    values = frame(spark, [(1.0,), (None,), (float("inf"),)], "v double")
    assert [r[0] for r in values.select(raster.encoded(F.col("v"))).collect()] == [1.0, -9999.0, -9999.0]
    assert [r[0] for r in raster.masked_in_range(frame(spark, [(1.0,), (-9999.0,)], "v double"), "v", -9999).collect()] == [1.0, None]


def test_cover_of_blocks(spark):
    rows = frame(spark, [(r, c, int(c < 2)) for r in range(4) for c in range(4)], "row int, col int, crop int")
    got = {(r.row, r.col): r.fraction for r in raster.fractional_cover(rows, F.col("crop") > 0, 2).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 1.0, (1, 1): 0.0}


def test_projection_and_pixel_window(spark):
    """The documented window: west 150,408 m, and 204 x 10044 pixels of 10 m from (199,980, 3,700,020)."""
    west, south, east, north = 35.45, 32.2, 35.65, 32.75
    e, n = geo.to_utm(F.col("lon"), F.col("lat"), 37)
    places = frame(spark, [(lon, lat) for lon in (west, 39.0, east) for lat in (south, 0.0, north, 60.0)], "lon double, lat double")
    lon, lat = geo.from_utm(e, n, 37)
    errors = places.select(F.abs(lon - F.col("lon")) + F.abs(lat - F.col("lat"))).collect()
    assert max(r[0] for r in errors) < 1e-9
    centre = places.filter("lon = 39 and lat = 0").select(e, n).first()
    assert centre[0] == pytest.approx(500000) and centre[1] == pytest.approx(0, abs=1e-6)
    box = {"west": F.lit(199980.0), "south": F.lit(3599580.0), "east": F.lit(202020.4), "north": F.lit(3700020.0)}
    window = geo.pixel_window(box, F.lit(199980.0), F.lit(3700020.0), 10.0)
    got = spark.range(1).select(*[v.alias(k) for k, v in window.items()], *geo.window_origin(window, F.lit(199980.0), F.lit(3700020.0), 10.0)).first()
    assert tuple(got) == (0, 0, 204, 10044, 199980.0, 3700020.0)


def test_common_box(spark):
    a = {k: F.lit(v) for k, v in {"west": 0.0, "south": 0.0, "east": 2.0, "north": 2.0}.items()}
    b = {k: F.lit(v) for k, v in {"west": 1.0, "south": -1.0, "east": 3.0, "north": 1.0}.items()}
    got = spark.range(1).select(geo.boxes_meet(a, b), *geo.common_box(a, b).values()).first()
    assert tuple(got) == (True, 1.0, 0.0, 2.0, 1.0)


def test_documented_window_of_the_study_box(spark):
    """Box 35.3-35.8 E, 32.0-33.3 N in zone 37, on the tile whose north-west is (199,980, 3,700,020)."""
    box = geo.projected_bounds(spark, (35.3, 32.0, 35.8, 33.3), 37)
    assert abs(box.first().west - 150408) < 1
    tile = {"west": F.lit(199980.0), "south": F.lit(3590220.0), "east": F.lit(309780.0), "north": F.lit(3700020.0)}
    both = geo.common_box({k: F.col(k) for k in ("west", "south", "east", "north")}, tile)
    window = geo.pixel_window(both, tile["west"], tile["north"], 10.0)
    got = box.select(*[v.alias(k) for k, v in window.items()]).first()
    assert (got.width, got.height, got.col_off, got.row_off) == (204, 10044, 0, 0) or (got.width, got.height) == (204, 10044)


def test_composite_from_long_bands(spark):
    rows = [("a", 0, 0, "red", 0.2), ("a", 0, 0, "nir", 0.6), ("a", 0, 0, "scl", 4.0), ("b", 0, 0, "red", 0.3), ("b", 0, 0, "nir", 0.5), ("b", 0, 0, "scl", 8.0), ("c", 0, 1, "red", 0.1), ("c", 0, 1, "nir", 0.3)]
    pixels = frame(spark, rows, "scene_id string, row int, col int, band string, value double")
    got = {(r.row, r.col): (r.value, r.scenes) for r in raster.vegetation_composite(pixels, raster.grid(spark, 1, 2)).collect()}
    assert got == {(0, 0): (pytest.approx(0.5, abs=1e-6), 1), (0, 1): (None, 0)}
    meta = {r.scene_id: (r.height, r.width, r.valid) for r in raster.metadata(pixels).collect()}
    assert meta["a"] == (1, 1, 3)
    cells = frame(spark, [(35.0, 32.0, 1.0), (36.0, 33.0, 3.0), (40.0, 33.0, 9.0)], "longitude double, latitude double, v double")
    assert tuple(raster.region_mean(cells, "v", (35, 32, 36, 33)).first()) == (2.0, 2)


@pytest.mark.parametrize("values", [[3.0], [1.0, 4.0], [5.0] * 6 + [1.0], [2.0, 1.0, 9.0, -4.0, 1.0, 7.5], [float(k * k % 37) for k in range(101)]])
def test_exact_median_from_counts(spark, values):
    rows = [(g, v, 1.0) for g in ("a", None) for v in values]
    out = raster.weighted_summary(spark.createDataFrame(rows, "g string, value double, w double"), "value", "w", ["g"]).collect()
    assert {r.g for r in out} == {"a", None} and all(r.median == pytest.approx(np.median(values)) for r in out)
    whole = raster.weighted_summary(spark.createDataFrame(rows, "g string, value double, w double"), "value", "w").first()
    assert whole.median == pytest.approx(np.median(values)) and whole.pixels == 2 * len(values)


def test_a_check_for_numbers_names_its_value_once(spark):
    df = spark.createDataFrame([(0, None), (1, float("nan")), (2, float("inf")), (3, -float("inf")), (4, 2.0), (5, 0.0)], "k int, v double")
    kept = df.filter(raster.finite(F.col("v") / (F.col("v") + 1)))
    assert [r.k for r in kept.collect()] == [4, 5]
    # Filters are pushed below what makes a value: each mention is computed anew.
    assert kept._jdf.queryExecution().optimizedPlan().toString().count(" / ") == 1
