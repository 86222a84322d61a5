"""Calendars of several sources, coarser grids, order statistics, tiles, boxes, nodes, blocks and streams against plain Python."""

import datetime as dt
import hashlib
import math
import random
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import alignment, forest, quantile, raster, splits, target
from terravane.operators.alignment import Source
from terravane.sources import blocks, evidence, tables, tiles
from terravane.streaming import windows

# One calendar.


def dekad_days(year, month, k):
    first = dt.date(year, month, 1 + 10 * k)
    last = first + dt.timedelta(9) if k < 2 else dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return first, last


def test_sources_are_dealt_out_by_days(spark):
    rng = random.Random(1)
    day = lambda: dt.date(2019, 12, 1) + dt.timedelta(rng.randrange(150))
    rows = []
    for _ in range(300):
        start = day()
        value = rng.choice([None, float("nan"), float("inf"), 1e9, *[rng.uniform(-5, 5)] * 12])
        rows.append((rng.choice([1, 2, None]), value, start, start + dt.timedelta(rng.choice([-1, 0, 0, 3, 9, 30, 70])), rng.choice([None, 0.0, -1.0, 0.25, 1.0, 3.0])))
    rows += [(1, 2.0, None, day(), 1.0), (1, 2.0, day(), None, 1.0)]
    df = spark.createDataFrame(rows, "place int, v double, a date, b date, w double").repartition(3)
    sources = {"level": Source(df, "v", "a", "b", weight="w"), "amount": Source(df, "v", "a", "b", amount=True), "point": Source(df, F.col("v") * 2, F.col("a").cast("timestamp"))}
    places = spark.createDataFrame([(1,), (2,), (3,), (3,)], "place int")
    got = {(r.place, r.time): r for r in alignment.aligned(sources, "2019-11-21", "2020-04-15", ["place"], places).collect()}
    starts = [x for x in (dekad_days(y, m, k) for y, m in [(2019, 11), (2019, 12), (2020, 1), (2020, 2), (2020, 3), (2020, 4)] for k in range(3)) if dt.date(2019, 11, 21) <= x[0] <= dt.date(2020, 4, 15)]
    assert set(got) == {(p, first) for p in (1, 2, 3) for first, _ in starts}
    for place in (1, 2, 3):
        for first, last in starts:
            r, sums = got[place, first], defaultdict(float)
            for p, v, a, b, w in rows:
                if p != place or a is None or v is None or not math.isfinite(v):
                    continue
                if first <= a <= last:
                    sums["point"] += 2 * v
                    sums["n_point"] += 1
                if b is None or b < a or (days := (min(b, last) - max(a, first)).days + 1) <= 0:
                    continue
                sums["amount"] += v * days / ((b - a).days + 1)
                sums["n_amount"] += 1
                if w is not None and w > 0:
                    sums["level"] += v * w * days
                    sums["weight"] += w * days
                    sums["n_level"] += 1
            assert (r.n_level, r.n_amount, r.n_point) == (sums["n_level"], sums["n_amount"], sums["n_point"])
            assert r.level == (pytest.approx(sums["level"] / sums["weight"], rel=1e-9) if sums["n_level"] else None)
            assert r.amount == (pytest.approx(sums["amount"], rel=1e-9, abs=1e-6) if sums["n_amount"] else None)
            assert r.point == (pytest.approx(sums["point"] / sums["n_point"], rel=1e-9) if sums["n_point"] else None)
    assert got[3, starts[0][0]].level is None and got[3, starts[0][0]].n_level == 0


def test_amounts_add_up_and_a_calendar_needs_no_places(spark):
    rows = [(7.0, dt.date(2020, 1, 5), dt.date(2020, 3, 2)), (3.0, dt.date(2020, 2, 29), dt.date(2020, 2, 29))]
    df = spark.createDataFrame(rows, "v double, a date, b date")
    got = alignment.aligned({"rain": Source(df, "v", "a", "b", amount=True)}, "2020-01-01", "2020-03-31").collect()
    assert len(got) == 9 and sum(r.rain or 0 for r in got) == pytest.approx(10.0)
    none = alignment.aligned({"rain": Source(df.limit(0), "v", "a", "b")}, "2020-01-01", "2020-01-31").collect()
    assert [(r.rain, r.n_rain) for r in none] == [(None, 0)] * 3
    with pytest.raises(ValueError, match="places"):
        alignment.aligned({"rain": Source(df, "v", "a")}, "2020-01-01", "2020-01-31", ["v"])


def test_dekads_are_numbered_without_gaps(spark):
    days = spark.createDataFrame([(dt.date(2019, 12, 25) + dt.timedelta(k),) for k in range(450)], "day date")
    rows = days.select("day", alignment.dekad_index(F.col("day")).alias("k")).withColumn("first", alignment.dekad_of(F.col("k"))).orderBy("day").collect()
    for r in rows:
        assert r["first"] <= r.day and (r["first"].year, r["first"].month) == (r.day.year, r.day.month) and r["first"].day == 1 + 10 * min(2, (r.day.day - 1) // 10)
    assert {b.k - a.k for a, b in zip(rows, rows[1:], strict=False)} == {0, 1}


# Coarser grids.


def kernel_means(cells, height, width, scale, shift):
    reach, out = max(1.0, 1 / scale), {}
    for r in range(height):
        for c in range(width):
            total = weight = 0.0
            for (i, j), v in cells.items():
                y, x = (i + 0.5 - shift[0]) / scale - 0.5, (j + 0.5 - shift[1]) / scale - 0.5
                w = max(0.0, 1 - abs(r - y) / reach) * max(0.0, 1 - abs(c - x) / reach)
                if w > 1e-12:
                    total, weight = total + v * w, weight + w
            if weight:
                out[r, c] = total / weight
    return out


@pytest.mark.parametrize(("scale", "shift", "height", "width"), [(10.0, (0.0, 0.0), 3, 2), (2.5, (1.0, -3.0), 12, 9), (1.0, (0.0, 0.0), 30, 20), (0.6, (0.5, 0.0), 20, 20)])
def test_widened_kernel_equals_a_double_loop(spark, scale, shift, height, width):
    rng = random.Random(3)
    cells = {(i, j): rng.uniform(-1, 1) for i in range(30) for j in range(20) if rng.random() < 0.8}
    rows = [("s", i, j, v) for (i, j), v in cells.items()] + [("s", 1, 21, None), ("s", 2, 21, float("nan")), ("t", 0, 0, 5.0)]
    df = spark.createDataFrame(rows, "scene_id string, row int, col int, value double").repartition(3)
    got = raster.smoothed(df, height, width, scale, shift).collect()
    found = {(r.row, r.col): r.value for r in got if r.scene_id == "s"}
    want = kernel_means(cells, height, width, scale, shift)
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert all(r.value == 5.0 for r in got if r.scene_id == "t")


def test_wide_and_four_neighbour_kernels_agree_on_finer_grids(spark):
    rows = [(1, i, j, float(i * i + 3 * j)) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(rows, "scene_id int, row int, col int, value double")
    a = {(r.row, r.col): r.value for r in raster.smoothed(df, 12, 12, 0.5).collect()}
    b = {(r.row, r.col): r.value for r in raster.bilinear(df, raster.grid(spark, 12, 12), 0.5).collect()}
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in a)


def test_constant_field_stays_exactly_constant_through_the_projection(spark):
    df = spark.range(200).crossJoin(spark.range(200).withColumnRenamed("id", "col")).select(F.lit("s").alias("scene_id"), F.col("id").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.lit(0.1).alias("value"))
    got = raster.reprojected_smoothed(df, 36, (699960.0, 3600020.0), 10.0, (35.125, 32.52), (0.001, 0.001), 15, 15).collect()
    assert len(got) > 150 and {r.value for r in got} == {0.1}
    sloped = raster.reprojected_smoothed(df.withColumn("value", F.col("row") + 0.0), 36, (699960.0, 3600020.0), 10.0, (35.125, 32.52), (0.001, 0.001), 15, 15).collect()
    by_row = defaultdict(list)
    for r in sloped:
        by_row[r.row].append(r.value)
    means = [np.mean(by_row[k]) for k in sorted(by_row)][2:-2]
    # A thousandth of a degree is about 111 m, eleven cells.
    assert all(9 < b - a < 13 for a, b in zip(means, means[1:], strict=False))


# Order statistics.


@pytest.mark.parametrize("leaf", [20, 10**6])
def test_quantiles_equal_a_sort(spark, leaf):
    rng = np.random.default_rng(4)
    groups = {
        "spread": rng.standard_normal(4000) * 10,
        "outlier": np.concatenate([rng.standard_normal(3000), [1e12, -1e12]]),
        "ties": rng.choice([1.0, 2.0, 2.5], 3000, p=[0.6, 0.3, 0.1]),
        "few": np.array([3.0, 1.0]),
        "one": np.array([7.5]),
        None: rng.exponential(size=2500) ** 8,
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("few", None), ("few", float("nan")), ("none", None), ("few", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    levels = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = {(r.g, r.level): (r.value, r.n) for r in quantile.exact_quantiles(df, "v", levels, ["g"], grid=16, leaf=leaf).collect()}
    assert set(got) == {(g, q) for g in groups for q in levels}
    for (g, q), (value, n) in got.items():
        assert n == len(groups[g]) and value == pytest.approx(np.quantile(groups[g], q), rel=1e-12, abs=1e-12)
    assert quantile.exact_quantiles(df.filter("v is null"), "v", [0.5]).count() == 0


def test_brackets_hold_few_values_whatever_the_outliers(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.standard_normal(20_000), [1e12] * 3, [-1e300]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select(F.lit(1).alias("g"), F.lit(0).alias("k"), "v").repartition(4)
    sketched = df.groupBy("g", "k").agg(F.count("*").alias("n"), F.percentile_approx("v", [j / 64 for j in range(65)], 10_000).alias("p"))
    ranks = spark.createDataFrame([(1, 0, len(values), 10_001, 10_002, 0.5)], "g int, k int, whole long, low long, high long, part double")
    found, kept = quantile.narrowed(df, sketched, ranks, 64)
    r, left = found.first(), sorted(x.v for x in kept.collect())
    assert len(left) <= 5 * len(values) / 64
    order = np.sort(values)
    assert (left[r.low], left[r.high]) == (order[10_001], order[10_002])
    # A sketch that is far off opens the bracket.
    wrong = sketched.withColumn("p", F.transform("p", lambda x: x * 0 + 50))
    found, kept = quantile.narrowed(df, wrong, ranks, 64)
    r, left = found.first(), sorted(x.v for x in kept.collect())
    assert (left[r.low], left[r.high]) == (order[10_001], order[10_002])


@pytest.mark.parametrize("few", [True, False])
def test_values_are_never_sent_to_all(spark, tmp_path, few):
    # Few bytes in their file, and many rows.
    spark.range(200_000).selectExpr("0 as g", "cast(id % 2 as double) as v").write.parquet(str(tmp_path / "v"))
    left = spark.read.parquet(str(tmp_path / "v"))
    sketched = spark.createDataFrame([(0, k, 200_000, [0.0, 0.0, 1.0, 1.0, 1.0]) for k in range(3)], "g int, k int, n long, p array<double>")
    ranks = spark.createDataFrame([(0, k, 200_000, 10, 10, 0.0) for k in range(3)], "g int, k int, whole long, low long, high long, part double")
    found, kept = quantile.narrowed(left, sketched, ranks, 4, ["g"], few)
    for plan in (t._jdf.queryExecution().executedPlan().toString() for t in (found, kept)):
        lines = plan.splitlines()
        for i in (i for i, line in enumerate(lines) if "BroadcastExchange" in line and few):
            below = lines[i + 1 : i + 3]
            assert not any("FileScan" in line for line in below)
        assert few or "BroadcastHashJoin" not in plan
    assert {(r.k, r.v): r.n for r in kept.groupBy("k", "v").agg(F.count("*").alias("n")).collect()}[0, 0.0] == 100_000


def test_thresholds_of_observations_and_of_a_series_agree(spark):
    rng = random.Random(6)
    rows = [(dt.date(1995 + k // 36, 1 + k % 12, 1 + k % 28), k % 12 + 1, rng.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "time date, month int, v double")
    a = {r.month: r.stress_threshold for r in target.observed_threshold(df, "v", 2001).collect()}
    b = {r.month: r.stress_threshold for r in target.seasonal_threshold(df, "v", 2001).collect()}
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)


# Order of rows.


def monotonic(df, **options):
    report = splits.leakage_report(df, [], [], ordinal="at", **options)
    return {r.check: r.passed for r in report.collect()}["monotonic_time"]


@pytest.mark.parametrize("base", [0, 1 << 60, -(1 << 60), (1 << 63) - 6000])
@pytest.mark.parametrize("step", [1, -1])
def test_order_by_large_ordinals(spark, base, step):
    df = spark.range(5000).select((F.lit(base) + F.col("id")).alias("at"), (F.lit(base // 2) + step * F.col("id")).alias("time")).repartition(4)
    assert monotonic(df) is (step == 1)


@pytest.mark.parametrize("at", ["int", "double", "date", "timestamp_ntz", "decimal"])
def test_order_by_ordinals_of_every_kind(spark, at):
    made = {"int": lambda k: k, "double": lambda k: k / 7, "date": lambda k: dt.date(2000, 1, 1) + dt.timedelta(k), "timestamp_ntz": lambda k: dt.datetime(2000, 1, 1) + dt.timedelta(microseconds=k), "decimal": lambda k: Decimal(10**25 + k)}[at]
    kind = "decimal(38,0)" if at == "decimal" else at
    # Rows with one ordinal are in the order of time; rows without one have no place.
    rows = [(made(k // 2), k, k % 3) for k in range(3000)] + [(None, -5, 0)]
    df = spark.createDataFrame(rows, f"at {kind}, time long, cell int").repartition(3)
    assert monotonic(df) is True and monotonic(df, partition_by=["cell"]) is True
    for broken in (1, 1500, 2998):
        assert monotonic(df.withColumn("time", F.when(F.col("time") == broken, 10_000 if broken < 2998 else -1).otherwise(F.col("time")))) is False


def test_order_of_files(spark, tmp_path):
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/sorted")
    spark.range(1000).orderBy(F.hash("id")).write.parquet(f"{tmp_path}/mixed")
    for name, want in (("sorted", True), ("mixed", False)):
        rows = tables.in_file_order(spark.read.parquet(f"{tmp_path}/{name}"), "at")
        assert rows.select("at").distinct().count() == 1000
        assert monotonic(rows.withColumnRenamed("id", "time")) is want


# Tiles.


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(8)
    cells = {(s, b, i, j): rng.choice([-9999.0, None, rng.uniform(0, 1), rng.uniform(0, 1)]) for s in ("x", "y") for b in ("red", "nir") for i in range(90) for j in range(70)}
    rows = [(*k, v) for k, v in cells.items()]
    pixels = spark.createDataFrame(rows, "scene_id string, band string, row int, col int, value double").repartition(3)
    profile = spark.createDataFrame([(s, b, 90, 70, [10.0, 0.0, 500.0, 0.0, -10.0, 900.0], "EPSG:32637", -9999.0, "float32", {"b": b, "nodata": "-9999"}) for s in ("x", "y") for b in ("red", "nir")], tiles.PROFILE)
    path = f"file://{tmp_path_factory.mktemp('tiles')}"
    tiles.write_raster(pixels, profile, path, tile=8, block=4)
    good = {k: float(np.float32(v)) for k, v in cells.items() if v is not None and v != -9999.0}
    return path, good, profile


@pytest.mark.parametrize("window", [(0, 0, 90, 70), (13, 21, 30, 9), (88, 60, 40, 40), (-5, -5, 10, 10), (40, 40, 1, 1)])
def test_windows_of_tiles(spark, written, window):
    path, good, _ = written
    r0, c0, h, w = window
    got = {(r.scene_id, r.band, r.row, r.col): r.value for r in tiles.read_window(spark, path, *window).collect()}
    assert got == {(s, b, i - r0, j - c0): v for (s, b, i, j), v in good.items() if r0 <= i < r0 + h and c0 <= j < c0 + w}


def test_a_window_opens_fewer_files(spark, written):
    path, good, _ = written

    def opened(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()

    whole, part = (tiles.read_window(spark, path, *w) for w in ((0, 0, 90, 70), (33, 33, 20, 20)))
    assert opened(part) == 1 < opened(whole) == 9
    red = tiles.read_window(spark, path, 33, 33, 20, 20, F.col("band") == "red")
    assert {r.band for r in red.collect()} == {"red"}
    scan = red._jdf.queryExecution().executedPlan().collectLeaves().head().metadata()
    assert "block_row" in scan.apply("PartitionFilters") and "GreaterThanOrEqual(tile_row" in scan.apply("PushedFilters") and "EqualTo(band,red)" in scan.apply("PushedFilters")
    assert tiles.read_window(spark, path, 0, 0, 0, 5).count() == 0 and tiles.read_window(spark, path, 500, 500, 9, 9).count() == 0


def test_profiles_come_back_and_windows_move_them(spark, written):
    path, good, profile = written
    back = tiles.read_profile(spark, path)
    key = lambda r: (r.scene_id, r.band, r.height, r.width, tuple(r["transform"]), r.crs, r.nodata, r.dtype, tuple(sorted(r.tags.items())))
    assert sorted(map(key, back.collect())) == sorted(map(key, profile.collect()))
    moved = tiles.window_profile(back, 13, 21, 30, 9).first()
    assert (moved.height, moved.width, moved["transform"]) == (30, 9, [10.0, 0.0, 710.0, 0.0, -10.0, 770.0])
    every = tiles.filled(tiles.read_window(spark, path, 0, 0, 90, 70), back)
    assert every.count() == 4 * 90 * 70 and every.filter("value = -9999").count() == 4 * 90 * 70 - len(good)


# Boxes.


def test_boxes_of_a_table_equal_those_of_one(spark):
    boxes = [(1, 35.45, 32.2, 35.65, 32.75), (2, 33.0, 31.0, 33.0, 31.5), (3, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(boxes, "k int, west double, south double, east double, north double")
    got = {r.k: r for r in geo.projected_boxes(df, "k", 36).collect()}
    for k, *box in boxes[:2]:
        one = geo.projected_bounds(spark, tuple(box), 36).first()
        assert all(got[k][s] == pytest.approx(one[s], abs=1e-6) for s in geo.SIDES)
    cut = {r.k: r for r in geo.windows_on_grid(geo.projected_boxes(df, "k", 36), 699960.0, 3700020.0, 10.0, 10980, 10980).collect()}
    assert not cut[1].empty and cut[1].own_west == 699960.0 + 10 * cut[1].col_off and cut[1].own_north == 3700020.0 - 10 * cut[1].row_off
    assert all(cut[k].empty and cut[k].west is None and cut[k].width is None for k in (2, 3))


def test_boxes_are_dealt_out_and_each_step_of_the_series_is_computed_once(spark):
    df = spark.range(1000).coalesce(1).selectExpr("id as k", "30.0 + id / 1000.0 as west", "31.0 as south", "31.5 + id / 1000.0 as east", "31.5 as north")
    found = geo.projected_boxes(df.union(df.limit(1)), "k", 36)
    # Four edges' conformal latitudes, and four terms of the series.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SINH(") == 8 and plan.count("ATAN2(") == 1
    assert found.rdd.getNumPartitions() >= geo.PARTS
    # Rows stay rows, equal ones too.
    assert Counter(r.k for r in found.collect()) == Counter([*range(1000), 0])


@pytest.mark.parametrize("finest", [1e-4, 0.5, 3.0])
def test_meeting_boxes_equal_all_pairs(spark, finest):
    rng = random.Random(9)

    def some(n):
        out = []
        for k in range(n):
            x, y = rng.choice([rng.uniform(-20, 20), float(rng.randrange(-20, 20))]), rng.uniform(-20, 20)
            w, h = rng.choice([(0, 0), (1, 1), (rng.random(), 3 * rng.random()), (0.001, 15), (40, 40)])
            out.append((k, x, y, x + w, y + h))
        return out + [(900, None, 0.0, 1.0, 1.0), (901, 5.0, 5.0, 4.0, 6.0), (902, float("nan"), 0.0, 1.0, 1.0), (903, -1.0, -1.0, float("inf"), 1.0)]

    a, b = some(60), some(80)
    df = [spark.createDataFrame(t, f"{k} int, west double, south double, east double, north double") for t, k in ((a, "a"), (b, "b"))]
    got = Counter((r.a, r.b) for r in geo.meeting_boxes(*df, finest=finest).select("a", "b").collect())
    meets = lambda p, q: p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]
    assert got == Counter((p[0], q[0]) for p in a[:60] for q in b[:80] if meets(p, q))
    plan = geo.meeting_boxes(*df)._jdf.queryExecution().executedPlan().toString()
    # Levels are the only thing met by a comparison: a few rows, broadcast.
    assert plan.count("BroadcastNestedLoopJoin") == 2 and "CartesianProduct" not in plan
    with pytest.raises(Exception, match="larger than the coarsest cell"):
        geo.meeting_boxes(*df, levels=2, finest=0.1).count()


def test_facts_of_meeting_boxes_equal_those_of_all_pairs(spark):
    rng = random.Random(10)

    def some(n, places):
        spots = [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([0.0, 0.5, 6.0])) for _ in range(places)]
        return [(k, x, y, x + w, y + w) for k in range(n) for x, y, w in [rng.choice(spots)]]

    a, b = some(60, 20), some(3000, 15)
    a += [(900, None, 0.0, 1.0, 1.0), (901, 0.0, 0.0, -1.0, 1.0), (0, *a[0][1:])]
    df = [spark.createDataFrame(t, f"{k} int, west double, south double, east double, north double") for t, k in ((a, "a"), (b, "b"))]
    found = geo.meeting_facts(*df, {"n": ("count", None), "low": ("min", "b"), "high": ("max", "b")})
    meets = lambda p, q: p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]
    wanted = []
    for p in a:
        if p[0] < 900 and (ids := [q[0] for q in b if meets(p, q)]):
            wanted.append((p[0], len(ids), min(ids), max(ids)))
    assert Counter(tuple(r) for r in found.select("a", "n", "low", "high").collect()) == Counter(wanted)


# The forest's nodes.


def test_nodes_score_like_the_model_and_in_sql(spark, tmp_path):
    import duckdb

    rows = spark.range(400).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.rand(1).alias("a"), (F.rand(2) + F.col("id") % 3).alias("b"), F.round(F.rand(3), 1).alias("c"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows, features = spark.read.parquet(f"{tmp_path}/rows"), ["a", "b", "c"]
    model = forest.fit(rows, features, "y", trees=12, depth=4)
    forest.save(model, f"{tmp_path}/model")
    nodes = forest.node_table(spark, f"{tmp_path}/model")
    nodes.write.parquet(f"{tmp_path}/nodes")
    want = {r.id: r.prob for r in forest.forecast(model, rows, features).collect()}
    got = {r.id: r.prob for r in forest.score_nodes(nodes, rows, ["id"], features, 4).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    sql = f"""WITH RECURSIVE nodes AS (SELECT * FROM '{tmp_path}/nodes/*.parquet'), walk AS (
        SELECT id, [a, b, c] AS x, tree, node FROM '{tmp_path}/rows/*.parquet', nodes WHERE node = 0
        UNION ALL SELECT id, x, w.tree, CASE WHEN x[feature + 1] <= cut THEN "left" ELSE "right" END FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE "left" IS NOT NULL)
      SELECT id, avg(shares[2]) FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE "left" IS NULL GROUP BY id"""
    found = dict(duckdb.sql(sql).fetchall())
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    own, summed = ({r.feature: r.importance for r in t.collect()} for t in (forest.importance(model, rows, features), forest.node_importance(nodes, features)))
    assert own == {k: pytest.approx(v, abs=1e-9) for k, v in summed.items()}
    share = dict(duckdb.sql(f"WITH g AS (SELECT tree, feature, sum(gain * weight) AS g FROM '{tmp_path}/nodes/*.parquet' WHERE feature IS NOT NULL GROUP BY ALL), s AS (SELECT feature, sum(g / t) AS s FROM g JOIN (SELECT tree, sum(g) AS t FROM g GROUP BY tree) USING (tree) GROUP BY feature) SELECT feature, s / sum(s) OVER () FROM s").fetchall())
    assert all(summed[features[k]] == pytest.approx(v, abs=1e-9) for k, v in share.items())


# Files in blocks.


def test_blocks_of_files(spark, tmp_path):
    rng = random.Random(10)
    content = {"a.bin": rng.randbytes(100_000), "sub/b.bin": b"%PDF-1.7 x", "empty.bin": b"", "c.txt": b"no", "_hidden.bin": b"1"}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = blocks.file_blocks(spark, f"file://{tmp_path}", "*.bin", block=30_000)
    got = {(r.path.removeprefix(f"{tmp_path}/"), r.block): r for r in found.collect()}
    assert set(got) == {("a.bin", 0), ("a.bin", 1), ("a.bin", 2), ("a.bin", 3), ("sub/b.bin", 0), ("empty.bin", 0)}
    for (name, k), r in got.items():
        data = content[name][30_000 * k : 30_000 * (k + 1)]
        assert (r.size, r.offset, r.length, r.sha256) == (len(content[name]), 30_000 * k, len(data), hashlib.sha256(data).hexdigest())
        assert r["head"] == (bytearray(data[:16]) if k == 0 else None)
    begins = evidence.sniffed(blocks.heads(blocks.file_blocks(spark, f"file://{tmp_path}", digest=False)).withColumn("path", F.regexp_replace("path", "b.bin$", "b.pdf")))
    assert {r.path.rpartition("/")[2]: r.accepted for r in begins.collect()} == {"a.bin": True, "b.pdf": True, "empty.bin": True, "c.txt": True}
    assert blocks.file_blocks(spark, f"file://{tmp_path}", digest=False).filter("sha256 is not null").isEmpty()


def test_blocks_are_dealt_to_tasks_of_bounded_size():
    files = [("big", 1_000_005), *((f"s{k:03}", 10) for k in range(500))]
    parts = blocks.planned(files, 1000, 50_000)
    assert max(sum(b[4] for b in p.blocks) for p in parts) <= 50_000 and len(parts) > 20
    assert sorted(b[:3] for p in parts for b in p.blocks) == sorted([("big", 1_000_005, k) for k in range(1001)] + [(n, s, 0) for n, s in files[1:]])
    assert blocks.planned([], 1000, 50_000) == []


def test_damaged_blocks_are_named(spark):
    table = lambda rows: spark.createDataFrame(rows, "path string, block long, sha256 string")
    have = table([("same", 0, "a"), ("same", 1, "b"), ("cut", 0, "a"), ("bent", 0, "a"), ("bent", 1, "x"), ("new", 0, "q")])
    want = table([("same", 0, "a"), ("same", 1, "b"), ("cut", 0, "a"), ("cut", 1, "c"), ("bent", 0, "a"), ("bent", 1, "b"), ("gone", 0, "z")])
    got = {r.path: (r.status, r.damaged) for r in blocks.verified_blocks(have, want).collect()}
    assert got == {"same": ("equal", []), "cut": ("changed", [1]), "bent": ("changed", [1]), "new": ("extra", [0]), "gone": ("missing", [0])}


# Indexes and streams.


def test_index_of_a_text_is_made_within_the_row(spark):
    texts = ["a b a", "", " ", "one", None, "x  y", "A a A ", "é e é", " ".join(str(k % 50) for k in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = df.select("k", "text", evidence.indexed(F.col("text")).alias("m")).withColumn("again", evidence.abstract(F.col("m")))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        if r.text is None:
            assert r.m is None and r.again is None
            continue
        want = defaultdict(list)
        for i, w in enumerate(r.text.split(" ")):
            want[w].append(i)
        assert r.m == want and r.again == r.text


def test_late_rows_are_dropped_after_restarts(spark, tmp_path):
    at = lambda day, hour=12: dt.datetime(2024, 1, day, hour)
    arrivals = [[(at(1), "x", 1.0), (at(2), "x", 2.0)], [(at(1), "x", 4.0), (at(4), "x", 8.0)], [(at(1), "x", 16.0), (at(3), "x", 32.0), (at(4), "x", 64.0)], [(at(9), "x", 128.0)]]
    parts = [spark.createDataFrame(a, "ts timestamp, event_type string, value double") for a in arrivals]
    got = {r.day.day: (r.n, r.total) for r in windows.in_arrivals(spark, parts, windows.daily_counts, f"file://{tmp_path}").collect()}
    # The third arrival's first day was closed when the second had come; the ninth day is not closed yet.
    assert got == {1: (2, 5.0), 2: (1, 2.0), 3: (1, 32.0), 4: (2, 72.0)}
