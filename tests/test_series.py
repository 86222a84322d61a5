import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from terravane.functions import calendar
from terravane.operators import series, splits, target


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def years(spark):
    """Seven years of a measure whose training months have known second-smallest values."""
    rows = [(dt.date(y, m, 1), float((y * 7 + m * 3) % 11), y, m) for y in range(2018, 2025) for m in range(1, 13)]
    return spark.createDataFrame(rows, "time date, v double, year int, month int")


def test_threshold_is_second_smallest_of_five(years):
    got = {r.month: r.stress_threshold for r in target.seasonal_threshold(years, "v", 2022).collect()}
    for m in range(1, 13):
        assert got[m] == sorted(float((y * 7 + m * 3) % 11) for y in range(2018, 2023))[1]


def test_flag_is_strict_and_training_has_at_most_one_event_a_month(years):
    flagged = target.flagged(years, target.seasonal_threshold(years, "v", 2022), "v")
    assert flagged.filter("v = stress_threshold and current_stress = 1").isEmpty()
    most = flagged.filter("year <= 2022").groupBy("month").agg(F.sum("current_stress").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 1


def test_targets_and_lags_lose_one_row_each(years):
    stress = target.stress_target(years, "v", 2022)
    assert stress.count() == 83
    out = series.lagged_features(stress, ["v"])
    assert out.count() == 82
    first = out.orderBy("time").first()
    assert first.time == day("2018-02-01") and first.v_lag1 == float((2018 * 7 + 3) % 11)
    assert math.isclose(first.month_sin, math.sin(math.pi / 3))


def test_missing_season_raises(spark, years):
    thresholds = target.seasonal_threshold(years.filter("month < 12"), "v", 2022)
    with pytest.raises(Exception, match="no threshold"):
        target.flagged(years, thresholds, "v").select("stress_threshold").collect()


def test_gap_positional_and_calendar(spark):
    rows = spark.createDataFrame([(day("2020-01-01"), 1.0), (day("2020-02-01"), 2.0), (day("2020-04-01"), 4.0)], "time date, v double")
    positional = {r.time.month: r.p for r in series.shifted(rows, ["v"], 1, "p").collect()}
    by_month = {r.time.month: r.p for r in series.shifted(rows, ["v"], 1, "p", calendar=True).collect()}
    assert positional == {1: None, 2: 1.0, 4: 2.0}
    assert by_month == {1: None, 2: 1.0, 4: None}


def test_empty_sum_stays_missing_and_nan_is_missing(spark):
    rows = spark.createDataFrame([(day("2020-01-03"), None, float("nan")), (day("2020-01-09"), None, 2.0)], "t date, a double, b double")
    clean = series.nan_to_null(rows)
    got = series.monthly(clean, "t", {"a": F.sum("a"), "b": F.avg("b")}).first()
    assert got.a is None and got.b == 2.0
    assert series.drop_all_missing(clean).columns == ["t", "b"]


def test_splits_and_embargo(years):
    out = splits.chronological(years, 2022)
    assert {r.split: (r["first"], r["last"], r.rows) for r in splits.bounds(out).collect()} == {
        "train": (day("2018-01-01"), day("2022-12-01"), 60),
        "validation": (day("2023-01-01"), day("2023-12-01"), 12),
        "test": (day("2024-01-01"), day("2024-12-01"), 12),
    }
    kept = {r.split: r["count"] for r in splits.chronological(years, 2022, embargo=1).groupBy("split").count().collect()}
    assert kept == {"train": 59, "validation": 11, "test": 12}


def test_leakage_report_sees_faults(spark, years):
    good = splits.chronological(years, 2022)
    assert all(r.passed for r in splits.leakage_report(good, ["v"], ["target"], ordinal="time").collect())
    twice = good.union(good.filter("month = 3")).withColumn("split", F.lit("train"))
    bad = {r.check: r.passed for r in splits.leakage_report(twice, ["v", "target"], ["target"]).collect()}
    assert not bad["unique_time"] and not bad["no_forbidden_feature"]


def test_rolling_origin_never_trains_on_the_future(years):
    out = splits.rolling_origin(years, 2021, 2023)
    ends = out.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("time"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("time"))).alias("b")).collect()
    assert len(ends) == 3 and all(r.a < r.b for r in ends)


@pytest.mark.parametrize(("date", "dekad", "start", "days"), [("2023-02-28", 3, "2023-02-21", 8), ("2024-02-29", 3, "2024-02-21", 9), ("2023-04-21", 3, "2023-04-21", 10), ("2023-01-31", 3, "2023-01-21", 11), ("2023-01-20", 2, "2023-01-11", 10), ("2023-01-10", 1, "2023-01-01", 10)])
def test_dekads(spark, date, dekad, start, days):
    t = F.lit(date).cast("date")
    got = spark.range(1).select(calendar.dekad(t), calendar.dekad_start(t), calendar.dekad_days(t)).first()
    assert tuple(got) == (dekad, day(start), days)


def test_decode_and_spines(spark):
    rows = spark.createDataFrame([(5.0,), (-9999.0,), (None,)], "raw double")
    assert [r[0] for r in rows.select(calendar.decode(F.col("raw"), 0.1, 1.0, -9999)).collect()] == [1.5, None, None]
    assert calendar.month_spine(spark, "2018-01-15", "2024-12-31").count() == 84
    assert calendar.dekad_spine(spark, "2023-12-05", "2024-02-29").count() == 8


def test_stacked_keeps_provenance(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert {tuple(r) for r in series.stacked({"a": a, "b": b}).collect()} == {(1, 2, "a"), (3, None, "b")}


def test_empty_tables(spark, years):
    none = years.limit(0)
    assert target.stress_target(none, "v", 2022).count() == 0
    assert splits.leakage_report(splits.chronological(none, 2022), [], []).filter("check = 'unique_time' and passed").count() == 1
