"""Named queries of the engine's edges: readers and writers, guards, and rasters through a projection.

What a reader reads is written from the driver tables first, so that SQL over the same tables says
what has to come back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import evaluate, forest, raster, target
from terravane.plans.catalogue import CELLS, FEATURES, FORECASTS, LAGGED, PIXELS, SCORES, SERIES, STRESS, Query, fitted, forecasts, months, pixels, r6, stress
from terravane.plans.catalogue import TARGET as STRESS_NEXT
from terravane.plans import report
from terravane.sources import evidence, scenes, tables
from terravane.sources.tables import table

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


# Readers and writers.


@query(f"WITH {SERIES} SELECT time, price, quantity, discount FROM series")
def csv_with_dates(spark: SparkSession, d: str) -> DataFrame:
    """The monthly series through CSV files with dates."""
    path = tables.scratch(spark)
    tables.write_csv(months(spark, d).select("time", "price", "quantity", "discount"), path)
    return tables.read_csv(spark, path, "time DATE, price DOUBLE, quantity DOUBLE, discount DOUBLE")


@query("SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def csv_plain(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch(spark)
    tables.write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice"), path)
    return tables.read_csv(spark, path, "p_partkey LONG, p_name STRING, p_brand STRING, p_retailprice DOUBLE")


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal, false AS fits_not FROM supplier UNION ALL SELECT NULL, NULL, NULL, true FROM supplier WHERE s_acctbal < 0")
def tsv_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as an evidence table; those in debt have a second line that does not fit, and headers are repeated."""
    path = tables.scratch(spark)
    s = table(spark, d, "supplier")
    line = F.concat_ws("\t", "s_suppkey", "s_name", F.round("s_acctbal", 2))
    lines = s.select(line.alias("l")).union(s.filter("s_acctbal < 0").select(F.concat(F.lit("none\t"), "s_name", F.lit("\tmuch")).alias("l")))
    lines.union(spark.range(3).select(F.lit("s_suppkey\ts_name\ts_acctbal").alias("l"))).write.text(path)
    rows = tables.read_tsv(spark, path, "s_suppkey STRING, s_name STRING, s_acctbal DOUBLE", key="s_suppkey", header=False)
    header = F.col("_corrupt_record").startswith("s_suppkey")
    bad = F.col("_corrupt_record").isNotNull()
    return rows.filter(F.coalesce(~header, F.lit(True))).select(F.when(~bad, F.col("s_suppkey").cast("long")).alias("s_suppkey"), F.when(~bad, F.col("s_name")).alias("s_name"), F.when(~bad, F.col("s_acctbal")).alias("s_acctbal"), bad.alias("fits_not"))


@query(f"WITH {STRESS} SELECT year, CAST(sum(target_stress_next) AS BIGINT) AS events FROM stress GROUP BY year")
def json_document(spark: SparkSession, d: str) -> DataFrame:
    """Events by year as one JSON document in one file, and back."""
    path = tables.scratch(spark)
    years = stress(spark, d).groupBy("year").agg(F.sum(STRESS_NEXT).cast("long").alias("events"))
    # A row for each year.
    whole = years.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("year", "events"))).alias("years"))).alias("value"))
    whole.coalesce(1).write.text(path)
    again = tables.read_json_document(spark, path, "years ARRAY<STRUCT<year: INT, events: LONG>>")
    return again.select(F.explode("years").alias("y")).select("y.*")


@query("SELECT r_regionkey, r_name FROM region")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch(spark)
    tables.write_json(table(spark, d, "region").select("r_regionkey", "r_name"), path)
    return spark.read.schema("r_regionkey LONG, r_name STRING").json(path)


@query("SELECT 'n_regionkey=' || min(n_regionkey) AS \"first\", count(DISTINCT n_regionkey) AS files, min(n_regionkey) = 0 AS found FROM nation")
def first_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first of a folder's files in path order, and how many there are."""
    path = tables.scratch(spark)
    table(spark, d, "nation").select("n_regionkey", "n_name").repartition(1).write.partitionBy("n_regionkey").csv(path)
    listed = tables.files(spark, path, "*.csv")
    name = F.regexp_extract("path", "(n_regionkey=[0-9]+)", 1)
    out = listed.agg(F.min(name).alias("first"), F.count("*").alias("files"))
    return out.withColumn("found", F.lit("n_regionkey=0" in tables.first_file(spark, path, "*.csv")))


def literature(spark: SparkSession, d: str) -> DataFrame:
    """A record a file for every nation: its comment's inverted index, and every fifth without a year."""
    path = tables.scratch(spark)
    n = table(spark, d, "nation")
    words = evidence.inverted(n, "n_nationkey", F.concat_ws(" ", "n_name", F.lit("of region"), "n_regionkey", F.lit("and key"), "n_nationkey", F.lit("of all")))
    index = words.groupBy("n_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("word", "positions"))).alias("abstract_inverted_index"))
    year = F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey").cast("int") + 1990)
    record = F.struct(F.concat(F.lit("W"), "n_nationkey").alias("id"), F.concat(F.lit("10.1/"), "n_nationkey").alias("doi"), F.col("n_name").alias("title"), year.alias("publication_year"), "abstract_inverted_index")
    n.join(index, "n_nationkey").select("n_nationkey", F.to_json(record).alias("value")).write.partitionBy("n_nationkey").text(path)
    return evidence.read_literature(spark, path)


@query("SELECT 'W' || n_nationkey AS id, n_name || ' of region ' || n_regionkey || ' and key ' || n_nationkey || ' of all' AS abstract FROM nation")
def literature_records(spark: SparkSession, d: str) -> DataFrame:
    return literature(spark, d).select("id", evidence.abstract(F.col("abstract_inverted_index")).alias("abstract"))


@query("SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'NA' ELSE CAST(n_nationkey + 1990 AS VARCHAR) END AS year, '10.1/' || n_nationkey AS doi, n_name AS title FROM nation")
def hit_list(spark: SparkSession, d: str) -> DataFrame:
    return evidence.hit_list(literature(spark, d))


@query("SELECT 'G' || n_nationkey AS producer_granule_id, n_name AS title, '2020-01-0' || (n_regionkey + 1) AS time_start FROM nation")
def granule_entries(spark: SparkSession, d: str) -> DataFrame:
    """Search responses, one for each region, with an entry for each nation."""
    path = tables.scratch(spark)
    entry = F.struct(F.concat(F.lit("G"), "n_nationkey").alias("producer_granule_id"), F.col("n_name").alias("title"), F.concat(F.lit("2020-01-0"), F.col("n_regionkey") + 1).alias("time_start"))
    feeds = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.struct(F.collect_list(entry).alias("entry")).alias("feed"))).alias("value"))
    feeds.write.partitionBy("n_regionkey").text(path)
    return evidence.read_granules(spark, path).select("producer_granule_id", "title", "time_start")


@query("""WITH files AS (SELECT page_id, ['pdf', 'html', 'nc', 'txt'][page_id % 4 + 1] AS extension,
    CASE WHEN page_id % 3 = 0 THEN '%PDF-1.4' WHEN page_id % 3 = 1 THEN 'CDF' ELSE '<!DOCTYPE html>' END AS head FROM pages)
  SELECT page_id, extension, NOT (starts_with(head, '<!') AND extension <> 'html') AND (extension IN ('html', 'txt') OR (extension = 'pdf' AND starts_with(head, '%PDF-')) OR (extension = 'nc' AND head = 'CDF')) AS accepted FROM files""")
def download_sniff(spark: SparkSession, d: str) -> DataFrame:
    """Pages under four extensions and with three kinds of beginnings."""
    k = F.col("page_id")
    extension = F.element_at(F.array(*map(F.lit, ("pdf", "html", "nc", "txt"))), (k % 4 + 1).cast("int"))
    head = F.when(k % 3 == 0, "%PDF-1.4").when(k % 3 == 1, "CDF").otherwise("<!DOCTYPE html>")
    files = table(spark, d, "pages").select("page_id", F.concat(F.lit("/a.b/"), k, F.lit("."), extension).alias("path"), F.encode(F.concat(head, F.coalesce("html", F.lit(""))), "UTF-8").alias("content"))
    return evidence.sniffed(files).select("page_id", "extension", "accepted")


@query("SELECT r_name, l.label FROM region JOIN (VALUES (0, 'low'), (1, 'mid'), (9, 'none')) l(k, label) ON r_regionkey = l.k")
def inline_rows(spark: SparkSession, d: str) -> DataFrame:
    labels = tables.inline(spark, [(0, "low"), (1, "mid"), (9, "none")], "k LONG, label STRING")
    # Three rows.
    return table(spark, d, "region").join(F.broadcast(labels), F.col("r_regionkey") == F.col("k")).select("r_name", "label")


@query(f"""WITH {FORECASTS}, c AS (SELECT split, model, {CELLS} FROM forecasts GROUP BY split, model), s AS (SELECT split, model, {SCORES} FROM c)
  SELECT split, model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM s""")
def metrics_from_document(spark: SparkSession, d: str) -> DataFrame:
    """The metrics' JSON document, written and read again."""
    path = tables.scratch(spark)
    document = report.nested(evaluate.evaluate(forecasts(spark, d), ["split", "model"]))
    # One document.
    document.coalesce(1).write.text(path)
    scores = "STRUCT<accuracy: DOUBLE, f1: DOUBLE>"
    again = spark.read.text(path, wholetext=True).select(F.from_json("value", f"MAP<STRING, MAP<STRING, {scores}>>").alias("m"))
    each = again.select(F.explode("m").alias("split", "n")).select("split", F.explode("n").alias("model", "s"))
    return each.select("split", "model", r6("s.accuracy").alias("accuracy"), r6("s.f1").alias("f1"))


@query(f"WITH {LAGGED} SELECT count(*) AS n, 8 AS features, true AS same FROM lagged WHERE split = 'test'")
def model_persistence(spark: SparkSession, d: str) -> DataFrame:
    """A forest, written and loaded again, forecasts alike and gives an importance for every feature."""
    path = tables.scratch(spark)
    model, rows = fitted(spark, d)
    forest.save(model, path)
    test = rows.filter("split = 'test'")
    a, b = (forest.forecast(m, test, FEATURES).select("time", F.col("prob").alias(n)) for m, n in ((model, "p"), (forest.load(path), "q")))
    found = forest.importance(model, rows, FEATURES).filter("importance >= 0").count()
    return a.join(b, "time").agg(F.count("*").alias("n"), F.lit(found).alias("features"), F.bool_and(F.col("p") == F.col("q")).alias("same"))


# Guards.


def _raises(run: Callable[[], object], kind: type[Exception], message: str) -> bool:
    """Whether it raises just this error; any other goes on."""
    try:
        run()
    except kind as error:
        if message not in str(error):
            raise
        return True
    return False


@query(f"""WITH {PIXELS}, scenes AS (SELECT 'S' || n_nationkey AS id, n_regionkey > 0 AS has_nir FROM nation),
  composed AS (SELECT "row", col, avg(value) AS value FROM used GROUP BY "row", col), counts AS (
  SELECT 'null_target' AS guard, count(*) FILTER (o_totalprice IS NULL) AS broken FROM orders
  UNION ALL SELECT 'null_target_of_some', count(*) FILTER (o_orderkey % 1000 = 0) FROM orders
  UNION ALL SELECT 'tolerant_range', count(*) FILTER (abs(value) > 1.01) FROM measured
  UNION ALL SELECT 'tolerant_range_of_twice', count(*) FILTER (abs(2 * value) > 1.01) FROM measured
  UNION ALL SELECT 'required_assets', 0 FROM (SELECT 1) UNION ALL SELECT 'missing_asset', count(*) FILTER (NOT has_nir) FROM scenes
  UNION ALL SELECT 'known_scene', CAST(count(*) FILTER (id = 'S1') = 0 AS BIGINT) FROM scenes UNION ALL SELECT 'unknown_scene', CAST(count(*) FILTER (id = 'S-1') = 0 AS BIGINT) FROM scenes
  UNION ALL SELECT 'no_file', CAST(count(*) FILTER (n_name LIKE '%.nothing') = 0 AS BIGINT) FROM nation
  UNION ALL SELECT 'same_grid', 64 - count(DISTINCT "row" * 8 + col) FROM pixels
  UNION ALL SELECT 'other_grid', count(*) FILTER (col = 7) FROM composed
  UNION ALL SELECT 'empty_mosaic', CAST(count(*) FILTER (value > 2) = 0 AS BIGINT) FROM measured)
  SELECT guard, broken, broken > 0 AS raised FROM counts""")
def guards(spark: SparkSession, d: str) -> DataFrame:
    """How many rows break each guard, and whether it raises its own error over the whole table."""
    orders = table(spark, d, "orders")
    some = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 != 0, F.col("o_totalprice")))
    values = pixels(spark, d).select(F.col("value").cast("double").alias("value"))
    twice = values.withColumn("value", F.col("value") * 2)
    nation = table(spark, d, "nation")
    assets = F.map_filter(F.create_map(F.lit("red"), F.col("n_name"), F.lit("nir"), F.when(F.col("n_regionkey") > 0, F.col("n_name"))), lambda _, v: v.isNotNull())
    catalogue = nation.select(F.concat(F.lit("S"), "n_nationkey").alias("id"), assets.alias("assets"))
    composed = raster.composite(raster.in_range(pixels(spark, d), "value"))
    cells = composed.select("row", "col", "value", F.lit(0.5).alias("fraction"))
    seen = pixels(spark, d).select("row", "col").distinct()
    path = tables.scratch(spark)
    nation.select("n_name").write.text(path)

    def run(df: DataFrame) -> Callable[[], object]:
        return lambda: df.write.format("noop").mode("overwrite").save()

    def broken(df: DataFrame, condition: str) -> DataFrame:
        return df.agg(F.count_if(F.expr(condition)).alias("broken"))

    def absent(df: DataFrame, condition: str) -> DataFrame:
        return df.agg((F.count_if(F.expr(condition)) == 0).cast("long").alias("broken"))

    raised = PySparkException
    checks = {
        "null_target": (broken(orders, "o_totalprice is null"), run(target.require(orders, "o_totalprice")), raised, "o_totalprice is missing"),
        "null_target_of_some": (broken(some, "o_totalprice is null"), run(target.require(some, "o_totalprice")), raised, "o_totalprice is missing"),
        "tolerant_range": (broken(values, "abs(value) > 1.01"), run(raster.guarded(values, "value")), raised, "value out of range"),
        "tolerant_range_of_twice": (broken(twice, "abs(value) > 1.01"), run(raster.guarded(twice, "value")), raised, "value out of range"),
        "required_assets": (broken(catalogue, "not map_contains_key(assets, 'red')"), run(scenes.requiring_assets(catalogue, ["red"])), raised, "assets missing"),
        "missing_asset": (broken(catalogue, "not map_contains_key(assets, 'nir')"), run(scenes.requiring_assets(catalogue, ["red", "nir"])), raised, "assets missing: nir"),
        "known_scene": (absent(catalogue, "id = 'S1'"), lambda: scenes.by_id(catalogue, "S1"), LookupError, "no scene S1"),
        "unknown_scene": (absent(catalogue, "id = 'S-1'"), lambda: scenes.by_id(catalogue, "S-1"), LookupError, "no scene S-1"),
        "no_file": (absent(tables.files(spark, path), "path like '%.nothing'"), lambda: tables.first_file(spark, path, "*.nothing"), FileNotFoundError, "no *.nothing in"),
        "same_grid": (seen.agg((F.lit(64) - F.count("*")).alias("broken")), run(raster.masked_mosaic(seen.withColumn("value", F.lit(1.0)), raster.grid(spark, 8, 8).withColumn("fraction", F.lit(0.5)))), raised, "not on both grids"),
        "other_grid": (broken(cells, "col = 7"), run(raster.masked_mosaic(cells, cells.filter("col < 7"))), raised, "not on both grids"),
        "empty_mosaic": (absent(values, "value > 2"), lambda: raster.masked_mosaic(cells.filter("value > 2"), cells), ValueError, "the mosaic is empty"),
    }
    out = None
    for name, (count, check, kind, message) in checks.items():
        row = count.select(F.lit(name).alias("guard"), F.col("broken").cast("long").alias("broken"), F.lit(_raises(check, kind, message)).alias("raised"))
        out = row if out is None else out.union(row)
    return out


@query(f"""WITH {PIXELS}, cells AS (SELECT r.range AS "row", c.range AS col FROM range(8) r, range(8) c),
  composed AS (SELECT "row", col, avg(value) AS value FROM used GROUP BY "row", col), cover AS (SELECT "row", col, avg(CAST(quality = 4 AS INTEGER)) AS fraction FROM pixels GROUP BY "row", col)
  SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(value, 6) AS value, round(fraction, 6) AS fraction FROM cells LEFT JOIN composed USING ("row", col) JOIN cover USING ("row", col)""")
def masked_mosaic(spark: SparkSession, d: str) -> DataFrame:
    """The composite with the share of a class, on one grid."""
    rows = pixels(spark, d)
    composed = raster.grid(spark, 8, 8).join(raster.composite(raster.in_range(rows, "value")), ["row", "col"], "left")
    out = raster.masked_mosaic(composed, raster.fractional_cover(rows, F.col("quality") == 4, 1))
    return out.select("row", "col", r6("value").alias("value"), r6("fraction").alias("fraction"))


# Rasters and boxes through the projection.


#: The published series to the fourth order in the third flattening, written out, for the independent engine.
KRUEGER_SQL = """earth AS (SELECT 6378137.0::DOUBLE AS radius, (1 / 298.257223563::DOUBLE) AS f), third AS (SELECT *, f / (2 - f) AS n FROM earth),
  series_ AS (SELECT 0.9996::DOUBLE * radius / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS metres, 2 * sqrt(n) / (1 + n) AS e,
    n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 AS a2, 61 * n ** 3 / 240 - 103 * n ** 4 / 140 AS a3, 49561 * n ** 4 / 161280 AS a4 FROM third)"""


def utm_sql(source: str, zone: int, columns: str) -> str:
    """CTEs that add ``easting`` and ``northing`` to a table with ``lon`` and ``lat``: the last is ``utm``."""
    return f"""{KRUEGER_SQL},
  conformal AS (SELECT p.*, s.*, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t, radians(lon - {zone * 6 - 183}) AS lam FROM {source} p, series_ s),
  sphere AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM conformal),
  utm AS (SELECT {columns}, lon, lat, 500000 + metres * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)) AS easting,
    metres * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)) AS northing FROM sphere)"""


@query(f"""WITH places AS (SELECT c_custkey, 35.0::DOUBLE + (c_custkey % 500) / 100.0::DOUBLE AS lon, 30.0::DOUBLE + (c_custkey % 300) / 100.0::DOUBLE AS lat FROM customer),
  {utm_sql("places", 37, "c_custkey")} SELECT c_custkey, round(easting, 3) AS easting, round(northing, 3) AS northing, true AS exact FROM utm""")
def utm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Places of all customers, projected to zone 37 and back to within a billionth of a degree."""
    places = table(spark, d, "customer").select("c_custkey", (F.lit(35.0) + (F.col("c_custkey") % 500) / 100.0).alias("lon"), (F.lit(30.0) + (F.col("c_custkey") % 300) / 100.0).alias("lat"))
    east, north = geo.to_utm(F.col("lon"), F.col("lat"), 37)
    out = places.withColumn("easting", east).withColumn("northing", north)
    lon, lat = geo.from_utm(F.col("easting"), F.col("northing"), 37)
    exact = F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))) <= 1e-9
    return out.select("c_custkey", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"), exact.alias("exact"))


#: A grid of 10 m cells from this corner in zone 36.
CORNER = (699960.0, 3700020.0)


@query(f"""WITH boxes AS (SELECT s_suppkey, 35.45::DOUBLE + s_nationkey / 1000.0::DOUBLE AS w, 32.2::DOUBLE - (s_suppkey % 40) / 100.0::DOUBLE AS s FROM supplier),
  places AS (SELECT s_suppkey, w + CASE WHEN e.range < 2 THEN 0.2::DOUBLE * k.range / 20 WHEN e.range = 2 THEN 0 ELSE 0.2::DOUBLE END AS lon, s + CASE WHEN e.range = 0 THEN 0 WHEN e.range = 1 THEN 0.55::DOUBLE ELSE 0.55::DOUBLE * k.range / 20 END AS lat FROM boxes, range(4) e, range(21) k),
  {utm_sql("places", 36, "s_suppkey")}, box AS (SELECT s_suppkey, greatest(min(easting), 699960.0) AS west, min(northing) AS south, max(easting) AS east, least(max(northing), 3700020.0) AS north FROM utm GROUP BY s_suppkey),
  win AS (SELECT *, CAST(round((west - 699960.0) / 10) AS INTEGER) AS col_off, CAST(round((3700020.0 - north) / 10) AS INTEGER) AS row_off, CAST(round((east - west) / 10) AS INTEGER) AS width, CAST(round((north - south) / 10) AS INTEGER) AS height FROM box)
  SELECT s_suppkey, round(west, 3) AS west, round(south, 3) AS south, round(east, 3) AS east, round(north, 3) AS north, col_off, row_off, width, height, 699960.0::DOUBLE + col_off * 10 AS own_west, 3700020.0::DOUBLE - row_off * 10 AS own_north FROM win""")
def utm_box_window(spark: SparkSession, d: str) -> DataFrame:
    """A box in degrees for each supplier, as a box in metres, cut to a grid, and as a window of that grid with its own origin."""
    west, south = F.lit(35.45) + F.col("s_nationkey") / 1000.0, F.lit(32.2) - (F.col("s_suppkey") % 40) / 100.0
    boxes = table(spark, d, "supplier").select("s_suppkey", west.alias("west"), south.alias("south"), (west + 0.2).alias("east"), (south + 0.55).alias("north"))
    placed = geo.windows_on_grid(geo.projected_boxes(boxes, "s_suppkey", 36, 20), *CORNER, 10.0, 370_000, 30_000)
    return placed.select("s_suppkey", *[F.round(s, 3).alias(s) for s in geo.SIDES], "col_off", "row_off", "width", "height", "own_west", "own_north")


_DEGREES = f"""source AS (SELECT scene AS scene_id, "row" AS sr, col AS sc, avg(weight) AS value FROM pixels GROUP BY scene, "row", col),
  target AS (SELECT r.range AS "row", c.range AS col, 39.05::DOUBLE + 0.12::DOUBLE * c.range AS lon, 32.3::DOUBLE - 0.1::DOUBLE * r.range AS lat FROM range(6) r, range(6) c),
  {utm_sql("target", 37, '"row", col')}, placed AS (SELECT "row", col, (3580000.0 - northing) / 10000.0 - 0.5 AS y, (easting - 500000.0) / 10000.0 - 0.5 AS x FROM utm)"""


def _in_degrees(spark: SparkSession, d: str, smooth: bool) -> DataFrame:
    """Cells of 10 km in zone 37 on a grid in degrees."""
    source = pixels(spark, d).groupBy(F.col("scene").alias("scene_id"), "row", "col").agg(F.avg("weight").alias("value"))
    cells = raster.grid(spark, 6, 6).withColumn("longitude", F.lit(39.05) + F.lit(0.12) * F.col("col")).withColumn("latitude", F.lit(32.3) - F.lit(0.1) * F.col("row"))
    return raster.reprojected(source, cells, 37, 500000.0, 3580000.0, 10000.0, smooth).withColumn("value", r6("value"))


@query(f"""WITH {PIXELS}, {_DEGREES} SELECT scene_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(value, 6) AS value
  FROM placed JOIN source ON sr = floor(y + 0.5) AND sc = floor(x + 0.5)""")
def raster_reprojected_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _in_degrees(spark, d, smooth=False)


@query(f"""WITH {PIXELS}, {_DEGREES}, corners AS (SELECT "row", col, floor(y) + i.range AS cr, floor(x) + j.range AS cc,
    (CASE WHEN i.range = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j.range = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM placed, range(2) i, range(2) j)
  SELECT scene_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(sum(value * w) / sum(w), 6) AS value FROM corners JOIN source ON sr = cr AND sc = cc WHERE w > 0 GROUP BY scene_id, "row", col""")
def raster_reprojected_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return _in_degrees(spark, d, smooth=True)


# Chart data.


@query(f"""WITH {FORECASTS} SELECT time, 'observed' AS line, CAST(y AS DOUBLE) AS value FROM forecasts WHERE model = 'margin' AND split = 'test'
  UNION ALL SELECT time, 'probability', prob FROM forecasts WHERE model = 'margin' AND split = 'test'""")
def plot_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Observed events against forecast probabilities."""
    rows = forecasts(spark, d).filter("model = 'margin' AND split = 'test'")
    return rows.select("time", F.expr("stack(2, 'observed', CAST(y AS DOUBLE), 'probability', prob) AS (line, value)")).orderBy("line", "time")
