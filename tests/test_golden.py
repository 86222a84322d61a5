"""Published tables, replayed: thresholds on forecasts, and the target and its lags on a series of seven years."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terravane.functions import calendar
from terravane.operators import evaluate, series, splits, target

# months' observed target and forest probability.
FORECASTS = [
    (0, 0.08950767665723929),
    (0, 0.06666328786166247),
    (0, 0.548203257646404),
    (0, 0.4407249682602525),
    (0, 0.41016998192098897),
    (0, 0.30562087484233175),
    (0, 0.1333731395203262),
    (0, 0.18492103793980455),
    (1, 0.35158526637321824),
    (0, 0.6665788883785925),
    (1, 0.3498146987341149),
]
# Threshold, accuracy, precision, recall, f1, predicted events.
TABLE = [
    (0.1, 0.36363636363636365, 0.2222222222222222, 1.0, 0.36363636363636365, 9),
    (0.15, 0.45454545454545453, 0.25, 1.0, 0.4, 8),
    (0.2, 0.5454545454545454, 0.2857142857142857, 1.0, 0.4444444444444444, 7),
    (0.25, 0.5454545454545454, 0.2857142857142857, 1.0, 0.4444444444444444, 7),
    (0.3, 0.5454545454545454, 0.2857142857142857, 1.0, 0.4444444444444444, 7),
    (0.35, 0.5454545454545454, 0.2, 0.5, 0.2857142857142857, 5),
    (0.4, 0.45454545454545453, 0.0, 0.0, 0.0, 4),
    (0.45, 0.6363636363636364, 0.0, 0.0, 0.0, 2),
    (0.5, 0.6363636363636364, 0.0, 0.0, 0.0, 2),
    (0.6, 0.7272727272727273, 0.0, 0.0, 0.0, 1),
    (0.7, 0.8181818181818182, 0.0, 0.0, 0.0, 0),
]


def test_threshold_table_is_reproduced(spark):
    df = spark.createDataFrame(FORECASTS, "y int, prob double")
    swept = evaluate.sweep(df, F.array(*[F.lit(r[0]) for r in TABLE]))
    got = {round(r.threshold, 4): (r.accuracy, r.precision, r.recall, r.f1, r.predicted_stress) for r in swept.collect()}
    assert {r[0]: pytest.approx(r[1:]) for r in TABLE} == got


# Monthly measures from January 2018 to December 2024, a year in a line.
MEASURES = [
    [0.4185793010752688, 0.4186354166666666, 0.3237163978494624, 0.3058805555555555, 0.2874059139784946, 0.2269111111111111, 0.2071787634408602, 0.207880376344086, 0.2072291666666666, 0.2320013440860215, 0.3197291666666667, 0.4068965053763441],
    [0.4289663978494624, 0.4251592261904762, 0.4289354838709677, 0.3848097222222222, 0.2538225806451613, 0.2237236111111111, 0.1891572580645161, 0.1942620967741935, 0.2130458333333333, 0.2360981182795699, 0.2468888888888888, 0.3740779569892473],
    [0.4730483870967741, 0.4565287356321839, 0.4364771505376343, 0.3572444444444445, 0.2874623655913979, 0.2415597222222222, 0.2284529569892473, 0.2361478494623655, 0.22615, 0.2379032258064516, 0.3574708333333333, 0.3870887096774193],
    [0.3825793010752688, 0.4389122023809524, 0.3778172043010753, 0.2873125, 0.2037137096774193, 0.1906277777777777, 0.1965806451612903, 0.2067822580645161, 0.2205611111111111, 0.2532849462365591, 0.2994805555555556, 0.4094247311827957],
    [0.4434220430107527, 0.4558779761904762, 0.4418588709677419, 0.3016583333333333, 0.224744623655914, 0.1997597222222222, 0.2118346774193548, 0.224263440860215, 0.2366194444444444, 0.2465497311827957, 0.3379055555555555, 0.3672903225806452],
    [0.3694422043010752, 0.4106830357142857, 0.3676263440860215, 0.3262847222222222, 0.2563548387096774, 0.2153930555555555, 0.2053870967741935, 0.2130309139784946, 0.2529888888888889, 0.2826774193548387, 0.3413888888888889, 0.423364247311828],
    [0.4610322580645161, 0.4742830459770115, 0.4085631720430107, 0.3326180555555555, 0.2694341397849462, 0.2469333333333333, 0.2480295698924731, 0.2499919354838709, 0.2304972222222222, 0.1923319892473118, 0.2998625, 0.2924811827956989],
]
# The published threshold of each month, and the cycle's sine and cosine.
THRESHOLDS = [
    (0.4185793010752688, 0.49999999999999994, 0.8660254037844387),
    (0.4251592261904762, 0.8660254037844386, 0.5000000000000001),
    (0.3778172043010753, 1.0, 6.123233995736766e-17),
    (0.3016583333333333, 0.8660254037844387, -0.4999999999999998),
    (0.224744623655914, 0.49999999999999994, -0.8660254037844387),
    (0.1997597222222222, 1.2246467991473532e-16, -1.0),
    (0.1965806451612903, -0.4999999999999997, -0.8660254037844388),
    (0.2067822580645161, -0.8660254037844385, -0.5000000000000004),
    (0.2130458333333333, -1.0, -1.8369701987210297e-16),
    (0.2360981182795699, -0.8660254037844386, 0.5000000000000001),
    (0.2994805555555556, -0.5000000000000004, 0.8660254037844384),
    (0.3740779569892473, -2.4492935982947064e-16, 1.0),
]
# The published flags of the 83 months that have a target, and the targets, a year in a word.
FLAGS = "011000001100 000000110010 000000000000 100111000000 000000000001 111000000000 00000000010"
TARGETS = "110000011000 000001100100 000000000001 001110000000 000000000011 110000000000 00000000101"


def replayed(spark):
    rows = [(dt.date(2018 + y, m + 1, 1), v) for y, year in enumerate(MEASURES) for m, v in enumerate(year)]
    months = series.with_calendar(spark.createDataFrame(rows, "time date, measure double").repartition(3))
    return target.stress_target(months, "measure", train_until=2022)


def test_targets_are_reproduced(spark):
    got = replayed(spark).orderBy("time").collect()
    flat = [v for year in MEASURES for v in year]
    assert len(got) == 83
    assert [r.stress_threshold for r in got] == pytest.approx([THRESHOLDS[r.month - 1][0] for r in got], rel=1e-12)
    assert "".join(str(r.current_stress) for r in got) == FLAGS.replace(" ", "")
    assert "".join(str(r.target_stress_next) for r in got) == TARGETS.replace(" ", "")
    assert [r.measure_next for r in got] == flat[1:]


def test_lagged_rows_and_splits_are_reproduced(spark):
    out = splits.chronological(series.lagged_features(replayed(spark), ["measure"]), 2022)
    got = out.orderBy("time").collect()
    flat = [v for year in MEASURES for v in year]
    assert len(got) == 82 and [r.measure_lag1 for r in got] == flat[:82]
    assert [(r.month_sin, r.month_cos) for r in got] == [pytest.approx(THRESHOLDS[r.month - 1][1:], abs=1e-12) for r in got]
    counts = {r.split: (r.n, r.events) for r in out.groupBy("split").agg(F.count("*").alias("n"), F.sum("target_stress_next").alias("events")).collect()}
    assert counts == {"train": (59, 12), "validation": (12, 2), "test": (11, 2)}


def test_observed_thresholds_equal_the_published_ones(spark):
    """The measures as single observations, through the refinement of quantiles."""
    rows = [(dt.date(2018 + y, m + 1, 1), v) for y, year in enumerate(MEASURES) for m, v in enumerate(year)]
    df = spark.createDataFrame(rows, "time date, measure double").withColumn("month", calendar.month_of(F.col("time")))
    got = {r.month: r.stress_threshold for r in target.observed_threshold(df, "measure", 2022).collect()}
    assert got == {m + 1: pytest.approx(v[0], rel=1e-12) for m, v in enumerate(THRESHOLDS)}
