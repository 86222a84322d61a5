import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import baselines, bootstrap, evaluate, forest
from terravane.plans import report


@pytest.fixture(scope="module")
def scored(spark):
    """Eleven months with two events and scores that tie with listed thresholds."""
    p = [0.08950767665723929, 0.06666328786166247, 0.5, 0.3, 0.25, 0.45, 0.62, 0.1, 0.31, 0.4, 0.2]
    y = [0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0]
    return spark.createDataFrame(list(zip(range(11), y, p, strict=True)), "id int, y int, prob double")


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_confusion_of_one_class_is_two_by_two(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    got = evaluate.evaluate(rows, []).first()
    assert got.confusion_matrix == [[2, 0], [0, 0]]
    assert (got.accuracy, got.precision, got.recall, got.f1) == (1.0, 0.0, 0.0, 0.0)
    auc = evaluate.roc_auc(rows.withColumn("prob", F.lit(0.5)), []).first().roc_auc
    assert auc is None


def test_auc_with_ties_and_symmetry(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, prob double")
    auc = evaluate.roc_auc(df, []).first().roc_auc
    assert auc == pytest.approx(brute_auc(rows))
    assert auc == pytest.approx(evaluate.roc_auc_pairs(df).first().roc_auc)
    assert auc + evaluate.roc_auc(df.withColumn("prob", -F.col("prob")), []).first().roc_auc == pytest.approx(1.0)


def test_sweep_equals_direct_metrics(scored):
    swept = {round(r.threshold, 2): r for r in evaluate.sweep(scored, evaluate.cut_offs(20, 60)).collect()}
    for t in (0.2, 0.25, 0.31, 0.6):
        direct = evaluate.evaluate(scored.withColumn("pred", (F.col("prob") >= t).cast("int")), []).first()
        assert (swept[t].accuracy, swept[t].precision, swept[t].recall, swept[t].f1) == (direct.accuracy, direct.precision, direct.recall, direct.f1)
        assert swept[t].predicted_stress == scored.filter(F.col("prob") >= t).count()


def test_best_threshold_takes_the_lowest_of_equals(spark):
    rows = spark.createDataFrame([(1, 0.8), (0, 0.2)], "y int, prob double")
    assert evaluate.best_threshold(evaluate.sweep(rows, evaluate.cut_offs())).first().threshold == 0.21


def test_published_baselines(spark):
    """Persistence on the held-out year: confusion [[8, 1], [2, 0]]; climatology [[9, 0], [2, 0]]."""
    rows = spark.createDataFrame([("persistence", 0, 0)] * 8 + [("persistence", 0, 1)] + [("persistence", 1, 0)] * 2 + [("climatology", 0, 0)] * 9 + [("climatology", 1, 0)] * 2, "model string, y int, pred int")
    got = {r.model: (round(r.accuracy, 4), r.f1, r.confusion_matrix) for r in evaluate.evaluate(rows, ["model"]).collect()}
    assert got == {"persistence": (0.7273, 0.0, [[8, 1], [2, 0]]), "climatology": (0.8182, 0.0, [[9, 0], [2, 0]])}


def test_climatology_falls_back_to_the_overall_rate(spark):
    train = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0)], "month int, target_stress_next int")
    later = spark.createDataFrame([(1,), (2,), (3,)], "month int")
    got = {r.month: (r.prob, r.pred) for r in baselines.climatology(later, train).collect()}
    assert got == {1: (0.5, 1), 2: (0.0, 0), 3: (0.25, 0)}
    assert [r.pred for r in baselines.persistence(train.withColumn("current_stress", F.lit(1))).collect()] == [1] * 4


def test_bootstrap_reproduces_the_published_interval(spark):
    """Two hits, five false alarms, four correct rejections: F1 0.444 within 0.000 and 0.800."""
    rows = spark.createDataFrame([(1, 1)] * 2 + [(0, 1)] * 5 + [(0, 0)] * 4, "y int, pred int")
    drawn = bootstrap.draws(rows, 2000)
    assert drawn.filter("tp + fp + fn > 11").isEmpty()
    got = {r.level: round(r.f1, 3) for r in bootstrap.interval(drawn).collect()}
    assert got == {0.025: 0.0, 0.5: 0.444, 0.975: 0.8}
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, bootstrap.draws(rows, 2000).collect()))


def test_bootstrap_of_nothing(spark):
    assert bootstrap.draws(spark.createDataFrame([], "y int, pred int"), 10).count() == 0


def test_forest_properties(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for k in range(80):
        x = rng.random()
        rows.append((dt.date(2015 + k // 12, k % 12 + 1, 1), x, rng.random(), int(x < 0.25)))
    df = spark.createDataFrame(rows, "time date, x double, noise double, y int").coalesce(1)
    weights = {r.y: r.weight * r.n for r in forest.class_weights(df, "y").collect()}
    assert weights[0] == pytest.approx(40) and weights[1] == pytest.approx(40)
    model = forest.fit(df, ["x", "noise"], "y", trees=30)
    out = forest.forecast(model, df, ["x", "noise"])
    assert out.filter("prob < 0 or prob > 1 or pred <> int(prob >= 0.5)").isEmpty() and out.count() == 80
    ranked = forest.importance(model, df, ["x", "noise"]).collect()
    assert ranked[0].feature == "x" and sum(r.importance for r in ranked) == pytest.approx(1)
    again = forest.forecast(forest.fit(df, ["x", "noise"], "y", trees=30), df, ["x", "noise"])
    assert [r.prob for r in again.orderBy("time").collect()] == [r.prob for r in out.orderBy("time").collect()]
    forest.save(model, str(tmp_path / "m"))
    assert forest.load(str(tmp_path / "m")).getNumTrees == 30


def test_report(spark):
    metrics = spark.createDataFrame([("test", "m", 0.54545, 0.4444, None)], "split string, model string, accuracy double, f1 double, roc_auc double")
    text = report.markdown(metrics, spark.createDataFrame([("a", 0.3), ("b", 0.7)], "feature string, importance double"))
    assert "| accuracy | 0.545 |" in text and "| roc_auc | nan |" in text.lower() and "b (0.700)" in text
    assert '"accuracy" : 0.54545' in report.nested(metrics).first().document
