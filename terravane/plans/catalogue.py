"""The named queries over the driver tables and their SQL for an independent engine.

``lineitem`` stands for the observed series: its months are the periods, its mean quantity the
measure whose low values are the events.  Years up to 1999 train, 2000 validates, 2001 tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import calendar, metrics
from terravane.operators import baselines, bootstrap, evaluate, forest, raster, series, splits, target
from terravane.plans import report
from terravane.sources import evidence, scenes, tables
from terravane.sources.tables import table
from terravane.streaming import windows

TRAIN_UNTIL = 1999
FEATURES = ["price", "quantity", "discount", "price_lag1", "quantity_lag1", "discount_lag1", "month_sin", "month_cos"]
TARGET = "target_stress_next"
#: The thresholds of the published table.
LISTED = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.60, 0.70)

Query = Callable[[SparkSession, str], DataFrame]
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


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# Parts of the SQL.
SERIES = """
months AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, round(sum(l_extendedprice), 2) AS price,
  round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1),
series AS (SELECT *, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month FROM months)"""
STRESS = SERIES + """,
thresholds AS (SELECT month, quantile_cont(quantity, 0.25) AS stress_threshold FROM series WHERE time < DATE '2000-01-01' GROUP BY month),
flagged AS (SELECT s.*, t.stress_threshold, CAST(s.quantity < t.stress_threshold AS INTEGER) AS current_stress
  FROM series s LEFT JOIN thresholds t ON s.month = t.month),
led AS (SELECT *, lead(current_stress) OVER (ORDER BY time) AS target_stress_next, lead(quantity) OVER (ORDER BY time) AS quantity_next FROM flagged),
stress AS (SELECT * FROM led WHERE target_stress_next IS NOT NULL)"""
LAGGED = STRESS + """,
lags AS (SELECT *, lag(price) OVER (ORDER BY time) AS price_lag1, lag(quantity) OVER (ORDER BY time) AS quantity_lag1,
  lag(discount) OVER (ORDER BY time) AS discount_lag1, sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos FROM stress),
lagged AS (SELECT *, CASE WHEN year <= 1999 THEN 'train' WHEN year = 2000 THEN 'validation' ELSE 'test' END AS split
  FROM lags WHERE price_lag1 IS NOT NULL AND year <= 2001)"""
FORECASTS = LAGGED + """,
rates AS (SELECT month, avg(target_stress_next) AS rate FROM lagged WHERE split = 'train' GROUP BY month),
overall AS (SELECT avg(target_stress_next) AS rate FROM lagged WHERE split = 'train'),
climatology AS (SELECT l.*, coalesce(r.rate, o.rate) AS p FROM lagged l LEFT JOIN rates r ON l.month = r.month CROSS JOIN overall o WHERE split <> 'train'),
margin AS (SELECT *, round(least(1.0, greatest(0.0, CAST(0.5 AS DOUBLE) + (stress_threshold - quantity) / 2)), 6) AS p FROM lagged WHERE split <> 'train'),
forecasts AS (
  SELECT split, time, 'persistence' AS model, target_stress_next AS y, current_stress AS pred, CAST(NULL AS DOUBLE) AS prob FROM lagged WHERE split <> 'train'
  UNION ALL SELECT split, time, 'climatology', target_stress_next, CAST(p >= 0.5 AS INTEGER), p FROM climatology
  UNION ALL SELECT split, time, 'margin', target_stress_next, CAST(p >= 0.5 AS INTEGER), p FROM margin)"""
CELLS = """count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp"""
SCORES = """round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
_SCORES = ("accuracy", "precision", "recall", "f1")


def months(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    out = series.monthly(lines, "l_shipdate", {"price": F.round(F.sum("l_extendedprice"), 2), "quantity": r6(F.avg("l_quantity")), "discount": r6(F.avg("l_discount"))})
    return series.with_calendar(out)


def stress(spark: SparkSession, d: str) -> DataFrame:
    return target.stress_target(months(spark, d), "quantity", TRAIN_UNTIL)


def lagged(spark: SparkSession, d: str) -> DataFrame:
    out = series.lagged_features(stress(spark, d), ["price", "quantity", "discount"])
    return splits.chronological(out, TRAIN_UNTIL)


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """A long table of the forecasts of three models on validation and test."""
    # A row for each month: written, so that the models read the series once.
    rows = tables.written(lagged(spark, d))
    train, later = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    margin = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + (F.col("stress_threshold") - F.col("quantity")) / 2))
    models = {
        "persistence": baselines.persistence(later),
        "climatology": baselines.climatology(later, train),
        "margin": later.withColumn("prob", r6(margin)).withColumn("pred", metrics.predicted(F.col("prob"), 0.5)),
    }
    parts = [t.select("split", "time", F.lit(m).alias("model"), F.col(TARGET).alias("y"), "pred", "prob") for m, t in models.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {SERIES} SELECT * FROM series")
def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    return months(spark, d)


@query(f"WITH {STRESS} SELECT month, round(stress_threshold, 6) AS stress_threshold FROM thresholds")
def seasonal_threshold(spark: SparkSession, d: str) -> DataFrame:
    return target.seasonal_threshold(months(spark, d), "quantity", TRAIN_UNTIL).select("month", r6("stress_threshold").alias("stress_threshold"))


@query(f"""WITH {STRESS} SELECT time, year, month, price, quantity, round(stress_threshold, 6) AS stress_threshold, current_stress,
  target_stress_next, quantity_next FROM stress""")
def stress_target(spark: SparkSession, d: str) -> DataFrame:
    return stress(spark, d).select("time", "year", "month", "price", "quantity", r6("stress_threshold").alias("stress_threshold"), "current_stress", TARGET, "quantity_next")


@query(f"""WITH {LAGGED} SELECT time, split, price, quantity, discount, price_lag1, quantity_lag1, discount_lag1,
  round(month_sin, 6) + 0.0 AS month_sin, round(month_cos, 6) + 0.0 AS month_cos, target_stress_next FROM lagged""")
def lagged_features(spark: SparkSession, d: str) -> DataFrame:
    cycle = [(r6(c) + F.lit(0.0)).alias(c) for c in ("month_sin", "month_cos")]
    return lagged(spark, d).select("time", "split", *FEATURES[:6], *cycle, TARGET)


@query("""WITH daily AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, l_suppkey % 4 AS cell, round(avg(l_quantity), 6) AS quantity
    FROM lineitem GROUP BY 1, 2)
  SELECT a.time, a.cell, a.quantity, b.quantity AS quantity_lag1 FROM daily a LEFT JOIN daily b ON a.cell = b.cell AND a.time = b.time + INTERVAL 1 MONTH""")
def calendar_lag(spark: SparkSession, d: str) -> DataFrame:
    """Lags by month in several cells."""
    rows = table(spark, d, "lineitem").withColumn("cell", F.col("l_suppkey") % 4)
    monthly = series.monthly(rows, "l_shipdate", {"quantity": r6(F.avg("l_quantity"))}, ["cell"])
    return series.shifted(monthly, ["quantity"], 1, "{}_lag1", partition_by=["cell"], calendar=True)


@query(f"WITH {STRESS} SELECT year, CAST(sum(target_stress_next) AS BIGINT) AS events, count(*) AS months, round(avg(target_stress_next), 6) AS rate FROM stress GROUP BY year")
def stress_by_year(spark: SparkSession, d: str) -> DataFrame:
    return stress(spark, d).groupBy("year").agg(F.sum(TARGET).cast("long").alias("events"), F.count("*").alias("months"), r6(F.avg(TARGET)).alias("rate"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("""SELECT 'unique_time' AS "check", count(*) = count(DISTINCT ts) AS passed FROM events
  UNION ALL SELECT 'monotonic_time', bool_and(ts >= before) FROM (SELECT ts, lag(ts, 1, ts) OVER (ORDER BY event_id) AS before FROM events)
  UNION ALL SELECT 'no_forbidden_feature', true""")
def event_order(spark: SparkSession, d: str) -> DataFrame:
    """Whether event times are unique and in the order of their identifiers, over all."""
    rows = table(spark, d, "events").select("event_id", "ts")
    return splits.leakage_report(rows, ["value"], ["label"], time="ts", ordinal="event_id")


@query(f"""WITH {LAGGED}, ends AS (SELECT max(time) FILTER (split = 'train') AS a, min(time) FILTER (split = 'validation') AS b,
    max(time) FILTER (split = 'validation') AS c, min(time) FILTER (split = 'test') AS d FROM lagged)
  SELECT 'unique_time' AS "check", count(*) = count(DISTINCT time) AS passed FROM lagged
  UNION ALL SELECT 'monotonic_time', true UNION ALL SELECT 'no_forbidden_feature', true
  UNION ALL SELECT 'train_before_validation', a < b FROM ends UNION ALL SELECT 'validation_before_test', c < d FROM ends""")
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.leakage_report(lagged(spark, d), FEATURES, [TARGET, "quantity_next"], ordinal="time")


@query(f'WITH {LAGGED} SELECT split, min(time) AS "first", max(time) AS "last", count(*) AS "rows" FROM lagged GROUP BY split')
def split_bounds(spark: SparkSession, d: str) -> DataFrame:
    return splits.bounds(lagged(spark, d))


@query(f"""WITH {LAGGED} SELECT split, count(*) AS n FROM lagged
  WHERE split = 'test' OR (split = 'train' AND time < DATE '1999-12-01') OR (split = 'validation' AND time < DATE '2000-12-01') GROUP BY split""")
def embargoed_split(spark: SparkSession, d: str) -> DataFrame:
    rows = lagged(spark, d).drop("split")
    return splits.chronological(rows, TRAIN_UNTIL, embargo=1).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {FORECASTS}, c AS (SELECT split, {CELLS} FROM forecasts WHERE model = 'persistence' GROUP BY split) SELECT split, tn, fp, fn, tp, {SCORES} FROM c")
def persistence_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.evaluate(forecasts(spark, d).filter("model = 'persistence'"), ["split"])
    return out.select("split", "tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in _SCORES])


@query(f"WITH {FORECASTS} SELECT time, y, pred, round(prob, 6) AS prob FROM forecasts WHERE model = 'climatology'")
def climatology_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).filter("model = 'climatology'").select("time", "y", "pred", r6("prob").alias("prob"))


@query(f"WITH {FORECASTS}, c AS (SELECT split, model, {CELLS} FROM forecasts GROUP BY split, model) SELECT split, model, {SCORES} FROM c")
def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate(forecasts(spark, d), ["split", "model"]).select("split", "model", *[r6(c).alias(c) for c in _SCORES])


@query(f"WITH {FORECASTS} SELECT split, model, {CELLS} FROM forecasts GROUP BY split, model")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("confusion_matrix")
    out = evaluate.evaluate(forecasts(spark, d), ["split", "model"])
    return out.select("split", "model", m[0][0].alias("tn"), m[0][1].alias("fp"), m[1][0].alias("fn"), m[1][1].alias("tp"))


@query(f"""WITH {FORECASTS}, r AS (SELECT split, model, y, rank() OVER (PARTITION BY split, model ORDER BY prob) + (count(*) OVER (PARTITION BY split, model, prob) - 1) / 2 AS rk
    FROM forecasts WHERE prob IS NOT NULL), s AS (SELECT split, model, sum(rk) FILTER (y = 1) AS w, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM r GROUP BY split, model)
  SELECT split, model, round((w - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS roc_auc FROM s""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_auc(forecasts(spark, d), ["split", "model"]).select("split", "model", r6("roc_auc").alias("roc_auc"))


@query(f"""WITH {FORECASTS}, a AS (SELECT prob FROM forecasts WHERE model = 'margin' AND split = 'test' AND y = 1), b AS (SELECT prob FROM forecasts WHERE model = 'margin' AND split = 'test' AND y = 0)
  SELECT round(avg(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN CAST(0.5 AS DOUBLE) ELSE 0.0 END), 6) AS roc_auc FROM a, b""")
def roc_auc_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_auc_pairs(forecasts(spark, d).filter("model = 'margin' AND split = 'test'")).select(r6("roc_auc").alias("roc_auc"))


_SWEPT = """g AS (SELECT threshold, count(*) FILTER (y = 1 AND prob >= threshold) AS tp, count(*) FILTER (y = 0 AND prob >= threshold) AS fp,
    count(*) FILTER (y = 1 AND prob < threshold) AS fn, count(*) FILTER (y = 0 AND prob < threshold) AS tn FROM forecasts, cuts WHERE model = 'margin' AND split = '{}' GROUP BY threshold)"""
_CUTS = "cuts AS (SELECT range / CAST(100 AS DOUBLE) AS threshold FROM range(10, 91))"


def _swept(spark: SparkSession, d: str, split: str, cuts: Column) -> DataFrame:
    out = evaluate.sweep(forecasts(spark, d).filter((F.col("model") == "margin") & (F.col("split") == split)), cuts)
    return out.select("threshold", *[r6(c).alias(c) for c in _SCORES], "predicted_stress")


@query(f"WITH {FORECASTS}, {_CUTS}, {_SWEPT.format('validation')} SELECT threshold, {SCORES}, tp + fp AS predicted_stress FROM g")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d, "validation", evaluate.cut_offs())


@query(f"WITH {FORECASTS}, cuts AS (SELECT unnest([{', '.join(map(str, LISTED))}]::DOUBLE[]) AS threshold), {_SWEPT.format('test')} SELECT threshold, {SCORES}, tp + fp AS predicted_stress FROM g")
def threshold_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d, "test", F.array(*[F.lit(t) for t in LISTED]))


@query(f"WITH {FORECASTS}, {_CUTS}, {_SWEPT.format('validation')}, s AS (SELECT threshold, {SCORES}, tp + fp AS predicted_stress FROM g) SELECT * FROM s ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_threshold(_swept(spark, d, "validation", evaluate.cut_offs()))


_DRAWS = f"""marked AS (SELECT CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS y, CAST(value >= 10 AS INTEGER) AS pred FROM events),
c AS (SELECT {CELLS} FROM marked),
drawn AS (SELECT b.range AS b, ('0x' || substr(md5(b.range || '-' || i.range), 1, 15))::BIGINT % (SELECT tn + fp + fn + tp FROM c) AS d
  FROM range(50) b, range((SELECT tn + fp + fn + tp FROM c)) i),
counted AS (SELECT b, count(*) FILTER (d < c.tp) AS tp, count(*) FILTER (d >= c.tp AND d < c.tp + c.fp) AS fp,
  count(*) FILTER (d >= c.tp + c.fp AND d < c.tp + c.fp + c.fn) AS fn FROM drawn, c GROUP BY b),
f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM counted)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").isin("purchase", "signup").cast("int").alias("y"), metrics.predicted(F.col("value"), 10).alias("pred"))


@query(f"WITH {_DRAWS} SELECT b, tp, fp, fn, round(f1, 6) AS f1 FROM f")
def bootstrap_f1(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.draws(_events(spark, d), 50).withColumn("f1", r6("f1"))


@query(f"WITH {_DRAWS} SELECT level, round(p, 6) AS f1 FROM (SELECT unnest([0.025, 0.5, 0.975]::DOUBLE[]) AS level, unnest(quantile_cont(f1, [0.025, 0.5, 0.975])) AS p FROM f)")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.interval(bootstrap.draws(_events(spark, d), 50)).withColumn("f1", r6("f1"))


@query(f"""WITH {LAGGED}, t AS (SELECT * FROM lagged WHERE split = 'train')
  SELECT target_stress_next, count(*) AS n, round((SELECT count(*) FROM t) / (2.0 * count(*)), 6) AS weight FROM t GROUP BY target_stress_next""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return forest.class_weights(lagged(spark, d).filter("split = 'train'"), TARGET).withColumn("weight", r6("weight"))


# Rasters: a line's part is its place on a grid of 8 x 8, its number the scene, two of its amounts the bands.
PIXELS = """
pixels AS (SELECT l_linenumber AS scene, CAST(floor((l_partkey % 64) / 8) AS INTEGER) AS "row", CAST(l_partkey % 8 AS INTEGER) AS col,
  CAST(l_tax * 10 AS FLOAT) AS red, CAST(l_discount * 10 AS FLOAT) AS nir, CAST(l_suppkey % 12 AS INTEGER) AS quality, l_quantity AS weight FROM lineitem),
measured AS (SELECT *, CASE WHEN quality NOT IN (0, 1, 3, 8, 9, 10, 11) AND nir + red <> 0 THEN CAST(CAST(nir - red AS DOUBLE) / CAST(nir + red AS DOUBLE) AS FLOAT) END AS value FROM pixels),
used AS (SELECT * FROM measured WHERE value BETWEEN -1.0 AND 1.0)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    out = rows.select(
        F.col("l_linenumber").alias("scene"),
        F.floor((F.col("l_partkey") % 64) / 8).cast("int").alias("row"),
        (F.col("l_partkey") % 8).cast("int").alias("col"),
        (F.col("l_tax") * 10).cast("float").alias("red"),
        (F.col("l_discount") * 10).cast("float").alias("nir"),
        (F.col("l_suppkey") % 12).cast("int").alias("quality"),
        F.col("l_quantity").alias("weight"),
    )
    return out.withColumn("value", raster.normalised_difference(F.col("nir"), F.col("red"), raster.clear(F.col("quality"))))


@query(f'WITH {PIXELS} SELECT scene, "row", col, count(*) AS n, count(value) AS valid, round(sum(CAST(value AS DOUBLE)), 4) AS total, round(min(CAST(value AS DOUBLE)), 5) AS low, round(max(CAST(value AS DOUBLE)), 5) AS high FROM measured GROUP BY scene, "row", col')
def masked_ratio_index(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value").cast("double")
    return pixels(spark, d).groupBy("scene", "row", "col").agg(F.count("*").alias("n"), F.count("value").alias("valid"), F.round(F.sum(v), 4).alias("total"), F.round(F.min(v), 5).alias("low"), F.round(F.max(v), 5).alias("high"))


@query(f'WITH {PIXELS} SELECT "row", col, round(avg(value), 6) AS value, count(value) AS scenes FROM used GROUP BY "row", col')
def composite_mean(spark: SparkSession, d: str) -> DataFrame:
    return raster.composite(raster.in_range(pixels(spark, d), "value")).withColumn("value", r6("value"))


@query(f"""WITH {PIXELS}, composed AS (SELECT scene, "row", col, avg(value) AS value FROM used GROUP BY scene, "row", col),
  cells AS (SELECT s.scene, r.range AS "row", c.range AS col FROM (SELECT DISTINCT scene FROM pixels) s, range(10) r, range(8) c)
  SELECT scene, count(value) AS covered, count(*) AS cells, round(count(value) / count(*), 6) AS fraction FROM cells LEFT JOIN composed USING (scene, "row", col) GROUP BY scene""")
def coverage_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Each scene's coverage of a grid of ten rows, two of which no scene reaches."""
    rows = pixels(spark, d)
    cells = raster.grid(spark, 10, 8).crossJoin(F.broadcast(rows.select("scene").distinct()))
    composed = raster.composite(raster.in_range(rows, "value"), keys=["scene", "row", "col"])
    return raster.coverage(cells, composed, ["scene", "row", "col"], ["scene"]).withColumn("fraction", r6("fraction"))


@query(f"""WITH {PIXELS} SELECT scene, round(sum(value * weight) / sum(weight), 6) AS weighted_mean, round(avg(value), 6) AS mean, round(median(CAST(value AS DOUBLE)), 6) AS median,
  round(min(CAST(value AS DOUBLE)), 6) AS min, round(max(CAST(value AS DOUBLE)), 6) AS max, count(*) AS pixels, round(sum(weight), 2) AS weight FROM used WHERE weight > 0 GROUP BY scene""")
def weighted_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = raster.in_range(pixels(spark, d), "value").withColumn("value", F.col("value").cast("double"))
    out = raster.weighted_summary(rows, "value", "weight", ["scene"])
    return out.select("scene", *[r6(c).alias(c) for c in ("weighted_mean", "mean", "median", "min", "max")], "pixels", F.round("weight", 2).alias("weight"))


@query(f"""WITH {PIXELS} SELECT CAST(floor("row" / 4) AS INTEGER) AS "row", CAST(floor(col / 4) AS INTEGER) AS col, round(avg(CAST(quality = 4 AS INTEGER)), 6) AS fraction
  FROM pixels GROUP BY 1, 2""")
def fractional_cover(spark: SparkSession, d: str) -> DataFrame:
    return raster.fractional_cover(pixels(spark, d), F.col("quality") == 4, 4).withColumn("fraction", r6("fraction"))


@query(f'WITH {PIXELS} SELECT "row" - 2 AS "row", col - 3 AS col, count(*) AS n FROM pixels WHERE "row" BETWEEN 2 AND 5 AND col BETWEEN 3 AND 6 GROUP BY 1, 2')
def raster_window(spark: SparkSession, d: str) -> DataFrame:
    return raster.windowed(pixels(spark, d), 2, 3, 4, 4).groupBy("row", "col").agg(F.count("*").alias("n"))


@query(f"""WITH {PIXELS} SELECT round(sum(CASE WHEN value IS NULL THEN -9999.0 ELSE value END), 2) AS total, count(*) FILTER (value IS NULL) AS missing FROM measured""")
def nodata_encoding(spark: SparkSession, d: str) -> DataFrame:
    written = pixels(spark, d).withColumn("v", raster.encoded(F.col("value").cast("double")))
    return written.agg(F.round(F.sum("v"), 2).alias("total"), F.count_if(F.col("v") == raster.NODATA).alias("missing"))


@query(f"""WITH {PIXELS}, marked AS (SELECT scene, "row", col, max(CASE WHEN scene <> 3 OR l % 2 = 0 THEN red END) AS red, max(nir) AS nir, max(CASE WHEN scene <> 5 THEN quality END) AS quality
    FROM (SELECT *, "row" + col AS l FROM pixels) GROUP BY 1, 2, 3),
  i AS (SELECT *, CASE WHEN quality NOT IN (0, 1, 3, 8, 9, 10, 11) AND nir + red <> 0 THEN CAST(CAST(nir - red AS DOUBLE) / CAST(nir + red AS DOUBLE) AS FLOAT) END AS value FROM marked),
  c AS (SELECT "row", col, avg(value) AS value, count(value) AS scenes FROM i WHERE value BETWEEN -1.0 AND 1.0 GROUP BY 1, 2),
  cells AS (SELECT r.range AS "row", c.range AS col FROM range(9) r, range(8) c)
  SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(value, 6) AS value, coalesce(scenes, 0) AS scenes FROM cells LEFT JOIN c USING ("row", col)""")
def vegetation_composite(spark: SparkSession, d: str) -> DataFrame:
    """The whole composite from long bands; scene 3 lacks half its red band, scene 5 its quality."""
    p = pixels(spark, d)
    bands = p.select(F.col("scene").alias("scene_id"), "row", "col", F.expr("stack(3, 'red', double(red), 'nir', double(nir), 'scl', double(quality)) AS (band, value)"))
    absent = (F.col("scene_id") == 3) & (F.col("band") == "red") & ((F.col("row") + F.col("col")) % 2 != 0) | (F.col("scene_id") == 5) & (F.col("band") == "scl")
    return raster.vegetation_composite(bands.filter(~absent), raster.grid(spark, 9, 8)).withColumn("value", r6("value"))


@query("""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS time, round(avg(o_totalprice), 6) AS price, count(o_totalprice) AS cells
  FROM orders WHERE o_custkey % 100 BETWEEN 20 AND 40 AND o_custkey % 70 BETWEEN 10 AND 30 GROUP BY 1""")
def region_series(spark: SparkSession, d: str) -> DataFrame:
    """Monthly means over the places within a box."""
    placed = table(spark, d, "orders").select(calendar.month_start(F.col("o_orderdate")).alias("time"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 100).alias("longitude"), (F.col("o_custkey") % 70).alias("latitude"))
    return raster.region_mean(placed, "price", (20, 10, 40, 30), by=["time"]).withColumn("price", r6("price"))


@query("""SELECT vec_id AS scene_id, 0 AS first_row, 0 AS first_col, 8 AS height, 8 AS width, CAST(64 AS BIGINT) AS cells, CAST(len(list_filter(embedding, lambda x: x IS NOT NULL)) AS BIGINT) AS valid FROM embeddings""")
def raster_metadata(spark: SparkSession, d: str) -> DataFrame:
    return raster.metadata(raster.reshaped(table(spark, d, "embeddings"), "vec_id", "embedding", 8))


GRID = """
cells AS (SELECT vec_id AS scene_id, CAST(floor((k - 1) / 8) AS INTEGER) AS r, CAST((k - 1) % 8 AS INTEGER) AS c, CAST(embedding[k] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
target AS (SELECT CAST(r.range AS INTEGER) AS "row", CAST(c.range AS INTEGER) AS col FROM range({n}) r, range({n}) c)"""


@query(f"""WITH {GRID.format(n=5)} SELECT scene_id, "row", col, round(value, 6) AS value FROM target JOIN cells ON r = floor(("row" + 0.5) * 1.6) AND c = floor((col + 0.5) * 1.6)""")
def raster_nearest(spark: SparkSession, d: str) -> DataFrame:
    source = raster.reshaped(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return raster.nearest(source, raster.grid(spark, 5, 5), 1.6).withColumn("value", r6("value"))


@query(f"""WITH {GRID.format(n=4)}, near AS (SELECT t.*, a, b, CASE WHEN a = 0 THEN CAST(0.5 AS DOUBLE) ELSE 0.5 END * CASE WHEN b = 0 THEN CAST(0.5 AS DOUBLE) ELSE 0.5 END AS w FROM target t, (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b))
  SELECT scene_id, "row", col, round(sum(value * w) / sum(w), 6) AS value FROM near JOIN cells ON r = 2 * "row" + a AND c = 2 * col + b GROUP BY 1, 2, 3""")
def raster_bilinear(spark: SparkSession, d: str) -> DataFrame:
    source = raster.reshaped(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return raster.bilinear(source, raster.grid(spark, 4, 4), 2.0).withColumn("value", r6("value"))


# Orders stand for scenes: their customer gives a place, their date the acquisition.
CATALOGUE = """scenes AS (SELECT 'S' || o_orderkey AS id, o_orderdate AS datetime, CAST(o_custkey % 100 AS DOUBLE) AS west, CAST(o_custkey % 70 AS DOUBLE) AS south,
  round(o_totalprice % 100, 2) AS cloud, o_orderkey % 5 <> 0 AS whole FROM orders)"""


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with a property map and three assets, one of which every fifth lacks."""
    o = table(spark, d, "orders")
    asset = F.struct(F.concat(F.lit("/scenes/"), "o_orderkey").alias("href"))
    whole = F.create_map(F.lit("red"), asset, F.lit("nir"), asset, F.lit("scl"), asset)
    assets = F.when(F.col("o_orderkey") % 5 != 0, whole).otherwise(F.create_map(F.lit("red"), asset, F.lit("nir"), asset))
    west, south = (F.col("o_custkey") % 100).cast("double"), (F.col("o_custkey") % 70).cast("double")
    return o.select(
        F.concat(F.lit("S"), "o_orderkey").alias("id"),
        F.col("o_orderdate").alias("datetime"),
        F.create_map(F.lit("eo:cloud_cover"), F.round(F.col("o_totalprice") % 100, 2).cast("string")).alias("properties"),
        assets.alias("assets"),
        west.alias("west"),
        south.alias("south"),
        (west + 5).alias("east"),
        (south + 5).alias("north"),
    )


@query(f"""WITH {CATALOGUE} SELECT id, CAST(datetime AS DATE) AS day, cloud AS cloud_cover FROM scenes
  WHERE west <= 40 AND west + 5 >= 30 AND south <= 30 AND south + 5 >= 20 AND datetime >= DATE '1996-01-01' AND datetime < DATE '1996-07-01' AND whole""")
def scene_catalogue_filter(spark: SparkSession, d: str) -> DataFrame:
    found = scenes.search(catalogue(spark, d), (30, 20, 40, 30), "1996-01-01", "1996-06-30")
    found = scenes.cloud_cover(scenes.with_assets(found, ["red", "nir", "scl"]))
    return found.select("id", F.col("datetime").cast("date").alias("day"), F.round("cloud_cover", 2).alias("cloud_cover"))


@query(f"""WITH {CATALOGUE}, near AS (SELECT * FROM scenes WHERE west <= 40 AND west + 5 >= 30 AND south <= 30 AND south + 5 >= 20)
  SELECT '1994-01-01/1994-12-31' AS range, count(*) AS scenes FROM near WHERE datetime >= DATE '1994-01-01' AND datetime < DATE '1995-01-01'
  UNION ALL SELECT '1994-01-01/1995-03-31', count(*) FROM near WHERE datetime >= DATE '1994-01-01' AND datetime < DATE '1995-04-01'""")
def widening_search(spark: SparkSession, d: str) -> DataFrame:
    return scenes.widened(catalogue(spark, d), (30, 20, 40, 30), [("1994-01-01", "1994-12-31"), ("1994-01-01", "1995-03-31")])


@query("""SELECT CAST(date_trunc('month', ts) AS DATE) + CAST((least(floor((day(ts) - 1) / 10), 2)) * 10 AS INTEGER) AS time, event_type, count(*) AS n, round(sum(value), 4) AS total
  FROM events GROUP BY 1, 2""")
def dekad_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(calendar.dekad_start(F.col("ts")).alias("time"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH m AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
  SELECT day, CAST(least(floor((day(day) - 1) / 10), 2) + 1 AS INTEGER) AS dekad, CAST(CASE WHEN day(day) <= 20 THEN 10 ELSE day(last_day(day)) - 20 END AS INTEGER) AS days FROM m""")
def dekad_lengths(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", calendar.dekad(F.col("day")).alias("dekad"), calendar.dekad_days(F.col("day")).alias("days"))


@query("""WITH spine AS (SELECT CAST(m + d AS DATE) AS time FROM (SELECT CAST(unnest(range(DATE '2023-12-01', DATE '2024-03-01', INTERVAL 1 MONTH)) AS DATE) AS m), (SELECT unnest([0, 10, 20]) AS d)),
  n AS (SELECT CAST(date_trunc('month', ts) AS DATE) + CAST((least(floor((day(ts) - 1) / 10), 2)) * 10 AS INTEGER) AS time, avg(value) AS value FROM events GROUP BY 1)
  SELECT s.time, round(n.value, 6) AS value FROM spine s LEFT JOIN n ON s.time = n.time""")
def dekad_spine(spark: SparkSession, d: str) -> DataFrame:
    """Means by dekad on a calendar; dekads without events stay missing."""
    e = table(spark, d, "events").groupBy(calendar.dekad_start(F.col("ts")).alias("time")).agg(F.avg("value").alias("value"))
    return calendar.dekad_spine(spark, "2023-12-01", "2024-02-29").join(e, "time", "left").select("time", r6("value").alias("value"))


@query("""SELECT l_returnflag, round(avg(CASE WHEN l_quantity <> 50 THEN l_quantity * 0.1 + 2 END), 6) AS decoded, count(*) FILTER (l_quantity = 50) AS nodata,
  round(avg(l_quantity * CASE WHEN day(l_shipdate) <= 20 THEN 10 ELSE day(last_day(l_shipdate)) - 20 END), 4) AS dekad_total FROM lineitem GROUP BY l_returnflag""")
def unit_decode(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("l_quantity")
    value = calendar.decode(raw, 0.1, 2.0, 50)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.avg(value)).alias("decoded"), F.count_if(value.isNull()).alias("nodata"), F.round(F.avg(calendar.per_dekad(raw, F.col("l_shipdate"))), 4).alias("dekad_total"))


@query("""SELECT l_linestatus, count(l_quantity / nullif(l_tax, 0)) AS defined, round(avg(l_quantity / nullif(l_tax, 0)), 4) AS ratio, round(avg(l_quantity - l_tax), 6) AS difference
  FROM lineitem GROUP BY l_linestatus""")
def ratio_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    q = F.try_divide("l_quantity", "l_tax")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count(q).alias("defined"), F.round(F.avg(q), 4).alias("ratio"), r6(F.avg(F.col("l_quantity") - F.col("l_tax"))).alias("difference"))


@query("""WITH a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS time, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1),
  b AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1),
  c AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
  SELECT time, orders, price, quantity, returned FROM a JOIN b USING (time) JOIN c USING (time)""")
def source_merge(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    a = series.monthly(table(spark, d, "orders"), "o_orderdate", {"orders": F.count("*"), "price": F.round(F.sum("o_totalprice"), 2)})
    b = series.monthly(lines, "l_shipdate", {"quantity": r6(F.avg("l_quantity"))})
    c = series.monthly(lines.filter("l_returnflag = 'R'"), "l_shipdate", {"returned": F.count("*")})
    return series.merged([a, b, c])


@query("""SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment""")
def customer_merge(spark: SparkSession, d: str) -> DataFrame:
    """Orders by nation and segment; Spark picks the joins by size."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("""SELECT source_file, count(*) AS n, round(sum(l_quantity), 2) AS quantity, count(l_tax) AS taxed FROM (
  SELECT 'early' AS source_file, l_quantity, l_tax FROM lineitem WHERE l_shipdate < DATE '1998-01-01'
  UNION ALL SELECT 'late', l_quantity, NULL FROM lineitem WHERE l_shipdate >= DATE '1998-01-01') GROUP BY source_file""")
def union_provenance(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    early = lines.filter(calendar.in_years(F.col("l_shipdate"), last=1997)).select("l_quantity", "l_tax")
    late = lines.filter(calendar.in_years(F.col("l_shipdate"), first=1998)).select("l_quantity")
    both = series.stacked({"early": early, "late": late})
    return both.groupBy("source_file").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("l_tax").alias("taxed"))


@query("""SELECT lang, count(*) AS n, count(quality) AS labelled, round(avg(coalesce(quality, (SELECT avg(quality) FROM labels))), 6) AS quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def map_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """A lookup whose missing entries get the mean of those there are."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality")
    # One row: a mean.
    joined = docs.join(labels, "doc_id", "left").join(F.broadcast(labels.agg(F.avg("quality").alias("mean"))))
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), r6(F.avg(F.coalesce("quality", "mean"))).alias("quality"))


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS digest, len(string_split(text, ' ')) AS words FROM documents")
def inverted_index_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Every document taken apart into an inverted index and put together again."""
    docs = table(spark, d, "documents").select("doc_id", evidence.indexed(F.col("text")).alias("index"))
    again = docs.select("doc_id", evidence.abstract(F.col("index")).alias("text"))
    return again.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.size(F.split("text", " ")).cast("long").alias("words"))


@query("SELECT page_id, starts_with(lower(ltrim(substr(html, 1, 64))), '<!doctype') OR starts_with(lower(ltrim(substr(html, 1, 64))), '<html') AS is_html FROM pages")
def content_sniff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", evidence.is_html(F.substring("html", 1, 64)).alias("is_html"))


@query("""WITH have AS (SELECT doc_id, sha256(text) AS h FROM documents), want AS (SELECT page_id, sha256(coalesce(d.text, html)) AS w
    FROM pages p LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) d ON d.doc_id = p.page_id)
  SELECT coalesce(doc_id, page_id) AS doc_id, CASE WHEN h IS NULL THEN 'missing' WHEN w IS NULL THEN 'extra' WHEN h = w THEN 'equal' ELSE 'changed' END AS status
  FROM have FULL OUTER JOIN want ON doc_id = page_id""")
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """The documents against a manifest of pages, in which labelled documents stand for the pages of their numbers."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id")
    want = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html").join(labelled, "doc_id", "left")
    want = want.select("doc_id", F.sha2(F.coalesce("text", "html"), 256).alias("sha256"))
    return evidence.verified(docs.select("doc_id", F.sha2("text", 256).alias("sha256")), want, "doc_id")


@query("""WITH c AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS "start", CASE WHEN o_custkey % 4 <> 0 THEN CAST(max(o_orderdate) AS DATE) END AS "end" FROM orders GROUP BY o_custkey)
  SELECT o_custkey, "start", "end", "start" <= DATE '1996-12-31' AND ("end" IS NULL OR "end" >= DATE '1996-01-01') AS overlaps FROM c""")
def coverage_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether each customer's span of orders, open for every fourth, meets a study year."""
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))
    spans = spans.withColumn("end", F.when(F.col("o_custkey") % 4 != 0, F.col("end")))
    return spans.withColumn("overlaps", evidence.overlaps(F.col("start"), F.col("end"), F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date")))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def top1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(1)


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size, p_partkey LIMIT 5")
def head_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size").orderBy("p_size", "p_partkey").limit(5)


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part GROUP BY p_brand")
def sorted_desc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), r6(F.avg("p_retailprice")).alias("price")).orderBy(F.desc("price"), "p_brand")


@query("""SELECT unnest(['o_orderkey', 'priced', 'never']) AS "column", (SELECT count(*) FROM orders) AS "rows",
  unnest([count(o_orderkey), count(CASE WHEN o_totalprice > 1000 THEN o_totalprice END), 0]) AS present, unnest([count(o_orderkey) = 0, count(CASE WHEN o_totalprice > 1000 THEN 1 END) = 0, true]) AS all_missing FROM orders""")
def all_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    priced = F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice"))
    return series.missing_report(table(spark, d, "orders").select("o_orderkey", priced.alias("priced"), F.lit(None).cast("double").alias("never")))


@query("SELECT count(*) FILTER (o_totalprice IS NULL) AS nulls, bool_or(o_totalprice IS NULL) AS any_null, bool_and(o_totalprice > 0) AS all_positive FROM orders")
def null_guard(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").agg(F.count_if(p.isNull()).alias("nulls"), F.bool_or(p.isNull()).alias("any_null"), F.bool_and(p > 0).alias("all_positive"))


@query(f"WITH {SERIES} SELECT time, 'price' AS line, price AS value FROM series UNION ALL SELECT time, 'quantity', quantity FROM series")
def plot_data(spark: SparkSession, d: str) -> DataFrame:
    """Points of a chart with two lines."""
    return months(spark, d).select("time", F.expr("stack(2, 'price', price, 'quantity', quantity) AS (line, value)")).orderBy("line", "time")


@query(f"""WITH {FORECASTS}, c AS (SELECT split, model, {CELLS} FROM forecasts GROUP BY split, model), s AS (SELECT split, model, {SCORES} FROM c)
  SELECT split, model, printf('%.3f', accuracy) AS accuracy_text, printf('%.3f', f1) AS f1_text FROM s""")
def metrics_report(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.evaluate(forecasts(spark, d), ["split", "model"]).withColumns({c: r6(c) for c in ("accuracy", "f1")})
    return report.with_text(out).select("split", "model", "accuracy_text", "f1_text")


@query()
def metrics_document(spark: SparkSession, d: str) -> DataFrame:
    """All metrics as one JSON document."""
    return report.nested(evaluate.evaluate(forecasts(spark, d), ["split", "model"]))


def fitted(spark: SparkSession, d: str) -> tuple[forest.RandomForestClassificationModel, DataFrame]:
    """A forest of the training months, and the months of all splits, written once."""
    # A row for each month: one partition makes refits agree.
    rows = tables.written(lagged(spark, d).coalesce(1))
    return forest.fit(rows.filter("split = 'train'").coalesce(1), FEATURES, TARGET, trees=100), rows


@query()
def rf_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Forest forecasts of the test months at the threshold that validation likes best."""
    model, rows = fitted(spark, d)
    validation = forest.forecast(model, rows.filter("split = 'validation'"), FEATURES).select(F.col(TARGET).alias("y"), "prob")
    best = evaluate.best_threshold(evaluate.sweep(validation, evaluate.cut_offs())).select("threshold")
    scored = forest.forecast(model, rows.filter("split = 'test'"), FEATURES).drop("pred")
    # One row: the threshold.
    return scored.join(F.broadcast(best)).select("time", F.col(TARGET).alias("y"), r6("prob").alias("prob"), "threshold", metrics.predicted(F.col("prob"), F.col("threshold")).alias("pred"))


@query()
def rf_importance(spark: SparkSession, d: str) -> DataFrame:
    model, rows = fitted(spark, d)
    return forest.importance(model, rows, FEATURES)


@query(f"""WITH {STRESS}, folds AS (SELECT f.range AS fold, s.* FROM stress s, range(1998, 2002) f WHERE s.year <= f.range)
  SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN year < fold THEN 'train' ELSE 'test' END AS role, count(*) AS n, CAST(sum(target_stress_next) AS BIGINT) AS events FROM folds GROUP BY 1, 2""")
def rolling_origin(spark: SparkSession, d: str) -> DataFrame:
    out = splits.rolling_origin(stress(spark, d), 1998, 2001)
    return out.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum(TARGET).cast("long").alias("events"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_window(spark: SparkSession, d: str) -> DataFrame:
    """The stream's daily windows over a table that has arrived whole."""
    return windows.daily_counts(table(spark, d, "events"))
