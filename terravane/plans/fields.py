"""Named queries over several sources at once: one calendar, coarser grids, tiles, boxes, and order statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import geo
from terravane.operators import alignment, forest, quantile, raster, splits, target
from terravane.operators.alignment import Source
from terravane.plans.catalogue import CATALOGUE, FEATURES, LAGGED, PIXELS, SERIES, TARGET, TRAIN_UNTIL, Query, catalogue, fitted, lagged, months, pixels, r6
from terravane.plans.edges import utm_sql
from terravane.sources import blocks, tables, tiles
from terravane.sources.tables import table
from terravane.streaming import windows

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# One calendar.

#: Dekads of a span, and observations dealt out over them by days of overlap; ``obs`` has (source, value, first, last, weight).
_DEKADS = """dekads AS (SELECT CAST(m + o AS DATE) AS time, CASE WHEN o = 20 THEN last_day(m) ELSE CAST(m + o + 9 AS DATE) END AS until
    FROM (SELECT CAST(unnest(range(DATE '{0}', DATE '{1}', INTERVAL 1 MONTH)) AS DATE) AS m), (SELECT unnest([0, 10, 20]) AS o)),
  parts AS (SELECT o.*, d.time, (least(o.last, d.until) - greatest(o.first, d.time) + 1) * weight AS share, (o.last - o.first + 1) AS whole
    FROM obs o JOIN dekads d ON o.first <= d.until AND o.last >= d.time WHERE value IS NOT NULL AND weight > 0)"""


def _level(name: str) -> str:
    return f"round(sum(value * share) FILTER (source = '{name}') / sum(share) FILTER (source = '{name}'), 6) AS {name}, count(*) FILTER (source = '{name}') AS n_{name}"


def _amount(name: str) -> str:
    return f"round(sum(value * share / whole) FILTER (source = '{name}'), 4) AS {name}, count(*) FILTER (source = '{name}') AS n_{name}"


_COVER = 'cover AS (SELECT "row", col, avg(CAST(quality = 4 AS INTEGER)) AS fraction FROM pixels GROUP BY "row", col)'


@query(f"""WITH {PIXELS}, {SERIES}, {_COVER}, obs AS (
    SELECT 'station' AS source, value, CAST(ts AS DATE) - 9497 AS first, CAST(ts AS DATE) - 9497 AS last, 1.0::DOUBLE AS weight FROM events WHERE event_type <> 'error'
    UNION ALL SELECT 'scene', l_extendedprice / 997, CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE), fraction
      FROM lineitem JOIN cover ON "row" = floor((l_partkey % 64) / 8) AND col = l_partkey % 8 WHERE l_discount > 0.02
    UNION ALL SELECT 'composite', o_totalprice / 997, CAST(date_trunc('week', o_orderdate) AS DATE), CAST(date_trunc('week', o_orderdate) AS DATE) + 6, 1.0 FROM orders WHERE o_orderdate < DATE '2000-02-10' OR o_orderdate > DATE '2000-05-20'
    UNION ALL SELECT 'level', quantity, time, last_day(time), 1.0 FROM series
    UNION ALL SELECT 'amount', price / 997, time, last_day(time), 1.0 FROM series),
  {_DEKADS.format("1994-12-01", "2002-01-01")},
  found AS (SELECT time, {_level("station")}, {_level("scene")}, {_level("composite")}, {_level("level")}, {_amount("amount")} FROM parts GROUP BY time)
  SELECT d.time, station, scene, composite, level, amount, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in ("station", "scene", "composite", "level", "amount"))} FROM dekads d LEFT JOIN found USING (time)""")
def dekad_sources(spark: SparkSession, d: str) -> DataFrame:
    """Five sources on one calendar of dekads: daily, by scene and cropland, by week, by month as level and as amount.

    Events stand 9497 days earlier, so that they fall into the years of the others.  Dekads that a
    source leaves out are there, without a value.
    """
    lines = table(spark, d, "lineitem").filter("l_discount > 0.02").withColumn("row", F.floor((F.col("l_partkey") % 64) / 8).cast("int")).withColumn("col", (F.col("l_partkey") % 8).cast("int"))
    cropland = raster.fractional_cover(pixels(spark, d), F.col("quality") == 4, 1)
    week = F.trunc("o_orderdate", "week")
    series = months(spark, d)
    day = F.date_sub(F.col("ts").cast("date"), 9497)
    sources = {
        "station": Source(table(spark, d, "events").filter("event_type <> 'error'"), "value", day),
        "scene": Source(lines.join(cropland, ["row", "col"]), F.col("l_extendedprice") / 997, "l_shipdate", weight="fraction"),
        "composite": Source(table(spark, d, "orders").filter("o_orderdate < '2000-02-10' or o_orderdate > '2000-05-20'"), F.col("o_totalprice") / 997, week, F.date_add(week, 6)),
        "level": Source(series, "quantity", "time", F.last_day("time")),
        "amount": Source(series, F.col("price") / 997, "time", F.last_day("time"), amount=True),
    }
    out = alignment.aligned(sources, "1994-12-01", "2001-12-31")
    return out.select("time", *[r6(c).alias(c) for c in ("station", "scene", "composite", "level")], F.round("amount", 4).alias("amount"), *[f"n_{n}" for n in sources])


@query(f"""WITH obs AS (
    SELECT s_nationkey AS place, 'shipped' AS source, l_quantity AS value, CAST(l_shipdate AS DATE) AS first, CAST(l_shipdate AS DATE) AS last, l_tax AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 3 <> 0
    UNION ALL SELECT c_nationkey, 'ordered', o_totalprice / 997, CAST(date_trunc('quarter', o_orderdate) AS DATE), CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 3 MONTH AS DATE) - 1, 1.0 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 <> 1),
  {_DEKADS.format("1999-01-01", "2000-01-01")},
  found AS (SELECT place, time, {_level("shipped")}, {_amount("ordered")} FROM parts GROUP BY place, time)
  SELECT n_nationkey AS place, d.time, shipped, ordered, coalesce(n_shipped, 0) AS n_shipped, coalesce(n_ordered, 0) AS n_ordered FROM nation n CROSS JOIN dekads d LEFT JOIN found f ON f.place = n_nationkey AND f.time = d.time""")
def dekad_places(spark: SparkSession, d: str) -> DataFrame:
    """Dated and quarterly sources by dekad of 1999 for every nation, also those without observations of one or both."""
    # Suppliers and nations are few beside lines and orders; Spark broadcasts them where their size allows.
    shipped = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).filter("s_nationkey % 3 <> 0").withColumn("place", F.col("s_nationkey"))
    ordered = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter("c_nationkey % 4 <> 1").withColumn("place", F.col("c_nationkey"))
    quarter = F.trunc("o_orderdate", "quarter")
    sources = {
        "shipped": Source(shipped, "l_quantity", "l_shipdate", weight="l_tax"),
        "ordered": Source(ordered, F.col("o_totalprice") / 997, quarter, F.date_sub(F.add_months(quarter, 3), 1), amount=True),
    }
    places = table(spark, d, "nation").select(F.col("n_nationkey").alias("place"))
    out = alignment.aligned(sources, "1999-01-01", "1999-12-31", ["place"], places)
    return out.select("place", "time", r6("shipped").alias("shipped"), F.round("ordered", 4).alias("ordered"), "n_shipped", "n_ordered")


# Coarser grids.


_FINE = """fine AS (SELECT l_linenumber AS scene_id, CAST(l_partkey % 80 AS INTEGER) AS r, CAST(l_suppkey % 60 AS INTEGER) AS c, sqrt(avg(l_extendedprice)) AS value FROM lineitem WHERE l_partkey % 80 < 70 OR l_linenumber > 3 GROUP BY 1, 2, 3)"""


def _fine(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of 80 x 60 cells, with holes; the first three end ten rows earlier."""
    lines = table(spark, d, "lineitem").filter("l_partkey % 80 < 70 or l_linenumber > 3")
    return lines.groupBy(F.col("l_linenumber").alias("scene_id"), (F.col("l_partkey") % 80).cast("int").alias("row"), (F.col("l_suppkey") % 60).cast("int").alias("col")).agg(F.sqrt(F.avg("l_extendedprice")).alias("value"))


@query(f"""WITH {_FINE}, cells AS (SELECT r.range AS "row", c.range AS col FROM range(8) r, range(6) c),
  near AS (SELECT scene_id, "row", col, value, (1 - abs((r + 0.5::DOUBLE) / 10 - 0.5 - "row")) AS wr, (1 - abs((c + 0.5::DOUBLE) / 10 - 0.5 - col)) AS wc FROM fine, cells)
  SELECT scene_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(sum(value * wr * wc) / sum(wr * wc), 6) AS value FROM near WHERE wr > 0 AND wc > 0 GROUP BY ALL""")
def raster_downsampled(spark: SparkSession, d: str) -> DataFrame:
    """Ten cells to one, with the kernel widened to the coarse cells."""
    return raster.smoothed(_fine(spark, d), 8, 6, 10.0).withColumn("value", r6("value"))


@query(f"""WITH {_FINE}, cells AS (SELECT r.range AS "row", c.range AS col FROM range(60) r, range(60) c),
  near AS (SELECT scene_id, "row", col, value, (1 - abs(("row" + 0.5::DOUBLE) * 0.7::DOUBLE + 2 - 0.5 - r)) AS wr, (1 - abs((col + 0.5::DOUBLE) * 0.7::DOUBLE - 1 - 0.5 - c)) AS wc FROM fine, cells WHERE abs("row" * 0.7 - r) < 5 AND abs(col * 0.7 - c) < 5)
  SELECT scene_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(sum(value * wr * wc) / sum(wr * wc), 6) AS value FROM near WHERE wr > 0 AND wc > 0 GROUP BY ALL""")
def raster_upsampled(spark: SparkSession, d: str) -> DataFrame:
    """The same operator towards a finer grid: four neighbours."""
    return raster.smoothed(_fine(spark, d), 60, 60, 0.7, (2.0, -1.0)).withColumn("value", r6("value"))


# Order statistics of single observations.


_OBSERVED = """observed AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS month, CASE WHEN l_partkey % 500 = 0 THEN 1e12 * (l_suppkey % 7 - 3) WHEN l_partkey % 7 <> 0 THEN l_extendedprice END AS price FROM lineitem WHERE l_shipdate < DATE '2000-01-01')"""


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Prices of all lines with their month; a few are trillions, of either sign, and a seventh is missing."""
    price = F.when(F.col("l_partkey") % 500 == 0, F.lit(1e12) * (F.col("l_suppkey") % 7 - 3)).when(F.col("l_partkey") % 7 != 0, F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("time"), F.month("l_shipdate").cast("int").alias("month"), price.alias("price"))


@query(f"WITH {_OBSERVED} SELECT month, round(quantile_cont(price, 0.25), 4) AS stress_threshold, count(price) AS n FROM observed GROUP BY month")
def observed_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds by calendar month over all training lines, with outliers."""
    return target.observed_threshold(_observed(spark, d), "price", TRAIN_UNTIL).withColumn("stress_threshold", F.round("stress_threshold", 4))


_LEVELS = [0.0, 0.001, 0.1, 0.5, 0.9, 0.999, 1.0]


@query(f"WITH {_OBSERVED} SELECT unnest({_LEVELS}::DOUBLE[]) AS level, round(unnest(quantile_cont(price, {_LEVELS})), 4) AS value, count(price) AS n FROM observed")
def refined_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Seven quantiles of one large group, refined until no more than 500 values are ordered at once."""
    train = _observed(spark, d).filter("time < date '2000-01-01'")
    return quantile.exact_quantiles(train, "price", _LEVELS, leaf=500).withColumn("value", F.round("value", 4))


# Order of files.


@query(f"""WITH {LAGGED}, ends AS (SELECT max(time) FILTER (split = 'train') AS a, min(time) FILTER (split = 'validation') AS b,
    max(time) FILTER (split = 'validation') AS c, min(time) FILTER (split = 'test') AS d FROM lagged),
  orders_ AS (SELECT 'by time' AS files, time, row_number() OVER (ORDER BY time) AS ordinal FROM lagged UNION ALL SELECT 'by price', time, row_number() OVER (ORDER BY price) FROM lagged),
  steps AS (SELECT files, time >= lag(time) OVER (PARTITION BY files ORDER BY ordinal) AS ok FROM orders_),
  kinds AS (SELECT DISTINCT files FROM orders_)
  SELECT files, 'monotonic_time' AS "check", bool_and(ok) AS passed FROM steps GROUP BY files
  UNION ALL SELECT files, 'unique_time', (SELECT count(*) = count(DISTINCT time) FROM lagged) FROM kinds UNION ALL SELECT files, 'no_forbidden_feature', true FROM kinds
  UNION ALL SELECT files, 'train_before_validation', a < b FROM ends, kinds UNION ALL SELECT files, 'validation_before_test', c < d FROM ends, kinds""")
def file_order(spark: SparkSession, d: str) -> DataFrame:
    """The checks for leaks on tables as they lie in their files: once sorted by time, and once by price."""
    found = None
    for name, column in (("by time", "time"), ("by price", "price")):
        path = tables.scratch(spark)
        # A row for each month.
        lagged(spark, d).orderBy(column).write.parquet(path)
        rows = tables.in_file_order(spark.read.parquet(path))
        report = splits.leakage_report(rows, FEATURES, [TARGET, "quantity_next"], ordinal="ordinal").select(F.lit(name).alias("files"), "check", "passed")
        found = report if found is None else found.union(report)
    return found


@query("""WITH shifted AS (SELECT CAST(ts AS DATE) AS day, ts, event_id + 1152921504606846976 AS event_id FROM events),
  steps AS (SELECT 'events' AS rows_of, ts >= lag(ts) OVER (ORDER BY event_id) AS ok FROM shifted UNION ALL SELECT 'events of a day', ts >= lag(ts) OVER (PARTITION BY day ORDER BY event_id) FROM shifted
    UNION ALL SELECT 'orders', o_orderdate >= lag(o_orderdate) OVER (ORDER BY -1152921504606846976 + o_orderkey, o_orderdate) FROM orders)
  SELECT rows_of, coalesce(bool_and(ok), true) AS monotonic FROM steps GROUP BY rows_of""")
def large_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Order by identifiers that no double can tell apart, of all rows and within partitions."""
    events = table(spark, d, "events").select(F.col("ts").cast("date").alias("day"), "ts", (F.col("event_id") + F.lit(1 << 60)).alias("event_id"))
    orders = table(spark, d, "orders").select("o_orderdate", (F.col("o_orderkey") - F.lit(1 << 60)).alias("o_orderkey"))
    checks = {
        "events": splits.leakage_report(events, [], [], time="ts", ordinal="event_id"),
        "events of a day": splits.leakage_report(events, [], [], time="ts", ordinal="event_id", partition_by=["day"]),
        "orders": splits.leakage_report(orders, [], [], time="o_orderdate", ordinal="o_orderkey"),
    }
    parts = [r.filter("check = 'monotonic_time'").select(F.lit(name).alias("rows_of"), F.col("passed").alias("monotonic")) for name, r in checks.items()]
    return parts[0].union(parts[1]).union(parts[2])


# Tiles.

_TAGS = "'scene=' || scene_id || ';source=lines'"
_TILED = """cells AS (SELECT 'S' || l_linenumber AS scene_id, CAST(l_partkey % 300 AS INTEGER) AS r, CAST(l_suppkey % 100 AS INTEGER) AS c, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)"""


def _tiled(spark: SparkSession, d: str) -> str:
    """Writes rasters of 300 x 100 cells, quantities of 50 being none, in tiles of 16 and blocks of 4 tiles."""
    path = tables.scratch(spark)
    lines = table(spark, d, "lineitem").withColumn("scene_id", F.concat(F.lit("S"), "l_linenumber"))
    pixels_ = lines.groupBy("scene_id", F.lit("quantity").alias("band"), (F.col("l_partkey") % 300).cast("int").alias("row"), (F.col("l_suppkey") % 100).cast("int").alias("col")).agg(F.max("l_quantity").alias("value"))
    transform = F.array(*[F.lit(v) for v in (10.0, 0.0, 699960.0, 0.0, -10.0, 3700020.0)])
    tags = F.create_map(F.lit("source"), F.lit("lines"), F.lit("scene"), F.col("scene_id"))
    profile = pixels_.select("scene_id", "band").distinct().select("scene_id", "band", F.lit(300).alias("height"), F.lit(100).alias("width"), transform.alias("transform"), F.lit("EPSG:32636").alias("crs"), F.lit(50.0).alias("nodata"), F.lit("float32").alias("dtype"), tags.alias("tags"))
    tiles.write_raster(pixels_, profile, path, tile=16, block=4)
    return path


@query(f"""WITH {_TILED} SELECT scene_id, r - 70 AS "row", c - 30 AS col, value FROM cells WHERE r BETWEEN 70 AND 139 AND c BETWEEN 30 AND 59 AND value <> 50""")
def tile_window(spark: SparkSession, d: str) -> DataFrame:
    """A window of 70 x 30 cells read from written tiles; see the tests for the files that it opens."""
    return tiles.read_window(spark, _tiled(spark, d), 70, 30, 70, 30).select("scene_id", "row", "col", "value")


@query(f"""WITH {_TILED} SELECT scene_id, 'quantity' AS band, 70 AS height, 30 AS width, 700260.0::DOUBLE AS west, 3699320.0::DOUBLE AS north, 'EPSG:32636' AS crs, 50.0::DOUBLE AS nodata, {_TAGS} AS tags,
    count(*) FILTER (value <> 50) AS valid, CAST(sum(CASE WHEN value <> 50 THEN value END) + 50 * (30000 - count(*) FILTER (value <> 50)) AS DOUBLE) AS total FROM cells GROUP BY scene_id""")
def raster_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile, tags and the moved transform of a window, with the sum of each whole raster, missing cells filled."""
    path = _tiled(spark, d)
    profile = tiles.read_profile(spark, path)
    whole = tiles.read_window(spark, path, 0, 0, 300, 100)
    sums = tiles.filled(whole, profile).groupBy("scene_id", "band").agg(F.sum("value").alias("total"))
    valid = whole.groupBy("scene_id", "band").agg(F.count("*").alias("valid"))
    out = tiles.window_profile(profile, 70, 30, 70, 30).join(sums, ["scene_id", "band"]).join(valid, ["scene_id", "band"])
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e.key, F.lit("="), e.value)), ";")
    return out.select("scene_id", "band", "height", "width", F.get("transform", F.lit(2)).alias("west"), F.get("transform", F.lit(5)).alias("north"), "crs", "nodata", tags.alias("tags"), "valid", "total")


# Boxes.

@query(f"""WITH boxes AS (SELECT c_custkey AS key, 32.0::DOUBLE + (c_custkey % 400) / 100.0::DOUBLE AS west, 31.0::DOUBLE + (c_custkey % 230) / 100.0::DOUBLE AS south, (1 + c_custkey % 7) / 20.0::DOUBLE AS size FROM customer),
  spots AS (SELECT key, west + CASE WHEN e.range < 2 THEN size * k.range / 20 WHEN e.range = 2 THEN 0 ELSE size END AS lon, south + CASE WHEN e.range = 0 THEN 0 WHEN e.range = 1 THEN size ELSE size * k.range / 20 END AS lat FROM boxes, range(4) e, range(21) k),
  {utm_sql("spots", 36, "key")}, around AS (SELECT key, greatest(min(easting), 399960) AS west, greatest(min(northing), 3490220) AS south, least(max(easting), 609760) AS east, least(max(northing), 3700020) AS north FROM utm GROUP BY key),
  cut AS (SELECT *, west < east AND south < north AS meets FROM around)
  SELECT key AS c_custkey, NOT meets AS empty, CASE WHEN meets THEN round(west, 3) END AS west, CASE WHEN meets THEN round(south, 3) END AS south, CASE WHEN meets THEN round(east, 3) END AS east, CASE WHEN meets THEN round(north, 3) END AS north,
    CASE WHEN meets THEN CAST(round((west - 399960) / 10) AS INTEGER) END AS col_off, CASE WHEN meets THEN CAST(round((3700020 - north) / 10) AS INTEGER) END AS row_off, CASE WHEN meets THEN CAST(round((east - west) / 10) AS INTEGER) END AS width, CASE WHEN meets THEN CAST(round((north - south) / 10) AS INTEGER) END AS height,
    CASE WHEN meets THEN 399960 + 10 * round((west - 399960) / 10) END AS own_west, CASE WHEN meets THEN 3700020 - 10 * round((3700020 - north) / 10) END AS own_north FROM cut""")
def box_windows(spark: SparkSession, d: str) -> DataFrame:
    """A box in degrees for every customer, in metres of zone 36, cut to a tile's grid, with its window; some miss the tile."""
    k = F.col("c_custkey")
    west, south, size = F.lit(32.0) + (k % 400) / 100.0, F.lit(31.0) + (k % 230) / 100.0, (1 + k % 7) / 20.0
    boxes = table(spark, d, "customer").select("c_custkey", west.alias("west"), south.alias("south"), (west + size).alias("east"), (south + size).alias("north"))
    placed = geo.windows_on_grid(geo.projected_boxes(boxes, "c_custkey", 36, 20), 399960.0, 3700020.0, 10.0, 20980, 20980)
    return placed.select("c_custkey", "empty", *[F.round(s, 3).alias(s) for s in geo.SIDES], "col_off", "row_off", "width", "height", "own_west", "own_north")


@query(f"""WITH {CATALOGUE}, boxes AS (SELECT c_custkey, (c_custkey * 7 % 3600) / 10.0::DOUBLE - 180 AS west, (c_custkey * 11 % 1700) / 10.0::DOUBLE - 85 AS south, CASE WHEN c_custkey % 500 = 0 THEN 40.0 WHEN c_custkey % 3 = 0 THEN 0.0 ELSE (c_custkey % 10) / 10.0 END::DOUBLE AS size FROM customer)
  SELECT c_custkey, count(*) AS scenes, min(id) AS first, CAST(max(datetime) AS DATE) AS last FROM boxes b JOIN scenes s ON s.west <= b.west + size AND s.west + 5 >= b.west AND s.south <= b.south + size AND s.south + 5 >= b.south GROUP BY c_custkey""")
def study_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The scenes of a catalogue that meet each of a table of study boxes: points, small boxes and a few very large ones."""
    k = F.col("c_custkey")
    west, south = (k * 7 % 3600) / 10.0 - 180, (k * 11 % 1700) / 10.0 - 85
    size = F.when(k % 500 == 0, F.lit(40.0)).when(k % 3 == 0, F.lit(0.0)).otherwise((k % 10) / 10.0)
    boxes = table(spark, d, "customer").select("c_custkey", west.alias("west"), south.alias("south"), (west + size).alias("east"), (south + size).alias("north"))
    scenes = catalogue(spark, d).select("id", "datetime", *geo.SIDES)
    met = geo.meeting_facts(boxes, scenes, {"scenes": ("count", None), "first": ("min", "id"), "last": ("max", "datetime")})
    # A customer's rows together, if there are several.
    return met.groupBy("c_custkey").agg(F.sum("scenes").alias("scenes"), F.min("first").alias("first"), F.max("last").cast("date").alias("last"))


# The forest as a table.


@query(f"WITH {LAGGED} SELECT time, split, target_stress_next AS y, true AS same FROM lagged")
def forest_node_scores(spark: SparkSession, d: str) -> DataFrame:
    """All months scored by joins with the forest's nodes; ``same`` compares with the fitted model, to a billionth."""
    model, rows = fitted(spark, d)
    path = tables.scratch(spark)
    forest.save(model, path)
    scored = forest.score_nodes(forest.node_table(spark, path), rows, ["time"], FEATURES, depth=5)
    whole = forest.forecast(model, rows, FEATURES).select("time", "split", F.col(TARGET).alias("y"), F.col("prob").alias("own"))
    return whole.join(scored, "time").select("time", "split", "y", (F.abs(F.col("prob") - F.col("own")) <= 1e-9).alias("same"))


@query(f"SELECT unnest({FEATURES}) AS feature, true AS same, 100 AS trees, true AS whole FROM (SELECT 1 FROM lineitem LIMIT 1)")
def forest_node_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importance summed over the nodes; ``same`` compares with the model's own, ``whole`` says that the shares add up."""
    model, rows = fitted(spark, d)
    path = tables.scratch(spark)
    forest.save(model, path)
    nodes = forest.node_table(spark, path)
    own = forest.importance(model, rows, FEATURES).withColumnRenamed("importance", "own")
    each = forest.node_importance(nodes, FEATURES)
    facts = nodes.agg(F.countDistinct("tree").cast("int").alias("trees"))
    total = each.agg((F.abs(F.sum("importance") - 1) <= 1e-9).alias("whole"))
    # One row each.
    return own.join(each, "feature").join(F.broadcast(facts)).join(F.broadcast(total)).select("feature", (F.abs(F.col("importance") - F.col("own")) <= 1e-9).alias("same"), "trees", "whole")


@query()
def importance_bars(spark: SparkSession, d: str) -> DataFrame:
    """Chart data of the importance, the least first, as bars are drawn from below, each with its place."""
    model, rows = fitted(spark, d)
    path = tables.scratch(spark)
    forest.save(model, path)
    each = forest.node_importance(forest.node_table(spark, path), FEATURES)
    # A row for each feature.
    return each.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("importance", F.desc("feature")))).orderBy("place")


# A stream.


@query("""WITH arrived AS (SELECT *, least(3, floor((day(ts) - 1) / 8) + CASE WHEN event_id % 40 = 0 THEN 1 + event_id % 3 ELSE 0 END) AS arrival FROM events),
  marks AS (SELECT a.range AS arrival, max(ts) FILTER (e.arrival < a.range) - INTERVAL 1 DAY AS mark FROM range(5) a, arrived e GROUP BY a.range),
  taken AS (SELECT a.* FROM arrived a JOIN marks m USING (arrival) WHERE m.mark IS NULL OR CAST(ts AS DATE) + INTERVAL 1 DAY > m.mark)
  SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM taken
  WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT mark FROM marks WHERE arrival = 4) GROUP BY 1, 2""")
def stream_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows over events that arrive in four parts, some of them late by one or more parts, with a restart at each.

    Rows too late for the watermark are dropped; days that it has not passed are not there.
    """
    events = table(spark, d, "events")
    late = F.when(F.col("event_id") % 40 == 0, 1 + F.col("event_id") % 3).otherwise(0)
    arrival = F.least(F.lit(3), F.floor((F.day("ts") - 1) / 8) + late)
    parts = [events.filter(arrival == k).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value") for k in range(4)]
    return windows.in_arrivals(spark, parts, windows.daily_counts, tables.scratch(spark))


# Files in blocks.

_CONTENTS = """contents AS (SELECT n_nationkey, ['txt', 'pdf', 'nc', 'html'][n_nationkey % 4 + 1] AS extension, CASE WHEN n_nationkey % 3 = 0 THEN '%PDF-' WHEN n_nationkey % 3 = 1 THEN 'CDF' ELSE '<html>' END || repeat(n_name, 1 + n_nationkey * 40) || chr(10) AS content FROM nation)"""


def _contents(spark: SparkSession, d: str, changed: bool = False) -> str:
    """Writes a file of one line for each nation, under four extensions and with three beginnings; every fifth may be changed or missing."""
    path = tables.scratch(spark)
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    head = F.when(k % 3 == 0, "%PDF-").when(k % 3 == 1, "CDF").otherwise("<html>")
    value = F.concat(head, F.expr("repeat(n_name, 1 + n_nationkey * 40)"))
    if changed:
        n = n.filter("n_nationkey % 10 <> 5")
        value = F.when(k % 5 == 0, F.concat(F.expr("left(value, 2000)"), F.lit("#"), F.expr("substr(value, 2002)"))).otherwise(F.col("value"))
    n.withColumn("value", F.concat(head, F.expr("repeat(n_name, 1 + n_nationkey * 40)"))).select("n_nationkey", value.alias("value")).write.partitionBy("n_nationkey").text(path)
    return path


@query(f"""WITH {_CONTENTS}, cut AS (SELECT n_nationkey, strlen(content) AS size, unnest(range(0, CAST(ceil(strlen(content) / 1000) AS BIGINT))) AS block, content FROM contents)
  SELECT n_nationkey, size, block, block * 1000 AS "offset", CAST(strlen(substr(content, block * 1000 + 1, 1000)) AS BIGINT) AS length, sha256(substr(content, block * 1000 + 1, 1000)) AS sha256, CASE WHEN block = 0 THEN substr(content, 1, 5) END AS head FROM cut""")
def file_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, beginnings and digests of written files, in blocks of a thousand bytes."""
    found = blocks.file_blocks(spark, _contents(spark, d), block=1000)
    key = F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("long")
    return found.select(key.alias("n_nationkey"), "size", "block", "offset", "length", "sha256", F.decode(F.substring("head", 1, 5), "UTF-8").alias("head"))


@query(f"""WITH {_CONTENTS}, other AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 AND strlen(content) > 2001 THEN substr(content, 1, 2000) || '#' || substr(content, 2002) WHEN n_nationkey % 5 = 0 THEN replace(content, chr(10), '#' || chr(10)) ELSE content END AS content FROM contents WHERE n_nationkey % 10 <> 5),
  facts AS (SELECT a.n_nationkey, a.content AS x, b.content AS y FROM contents a LEFT JOIN other b USING (n_nationkey))
  SELECT n_nationkey, CASE WHEN y IS NULL THEN 'missing' WHEN x = y THEN 'equal' ELSE 'changed' END AS status,
    coalesce(array_to_string([b FOR b IN range(0, CAST(ceil(greatest(strlen(x), coalesce(strlen(y), 0)) / 1000) AS BIGINT)) IF y IS NULL OR substr(x, b * 1000 + 1, 1000) <> substr(y, b * 1000 + 1, 1000)], ','), '') AS damaged FROM facts""")
def damaged_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Files against a manifest by blocks: some are changed in one block, some missing."""
    sides = []
    for changed in (True, False):
        found = blocks.file_blocks(spark, _contents(spark, d, changed), block=1000)
        sides.append(found.withColumn("path", F.regexp_extract("path", "n_nationkey=([0-9]+)", 1)))
    out = blocks.verified_blocks(*sides)
    return out.select(F.col("path").cast("long").alias("n_nationkey"), "status", F.array_join("damaged", ",").alias("damaged"))
