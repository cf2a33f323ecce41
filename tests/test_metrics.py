import random

import pytest
from pyspark.sql import functions as F

from basketlake.operators import kpis, metrics


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.choice([i / 20 for i in range(21)])) for _ in range(500)]
    frame = spark.createDataFrame(
        [(y, p, int(p >= 0.5)) for y, p in rows],
        "converted int, probability_1 double, prediction int")
    return frame, rows


def counts(rows, threshold):
    tp = sum(1 for y, p in rows if y == 1 and p >= threshold)
    fp = sum(1 for y, p in rows if y == 0 and p >= threshold)
    fn = sum(1 for y, p in rows if y == 1 and p < threshold)
    return tp, fp, fn, len(rows) - tp - fp - fn


def test_sweep_against_counting(predictions):
    frame, rows = predictions
    got = metrics.threshold_sweep(frame).collect()
    assert [r["threshold"] for r in got] == metrics.THRESHOLDS
    for r in got:
        tp, fp, fn, tn = counts(rows, r["threshold"])
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)
        assert r["accuracy"] == pytest.approx((tp + tn) / len(rows))
        assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))


def test_counts_add_up_and_report(predictions):
    frame, rows = predictions
    c = metrics.confusion_counts(frame).first()
    assert sum(c) == len(rows) and tuple(c) == counts(rows, 0.5)
    report = {r["class"]: r for r in metrics.class_report(frame).collect()}
    assert report["1"]["support"] == c["tp"] + c["fn"]
    assert report["1"]["recall"] == pytest.approx(c["tp"] / (c["tp"] + c["fn"]))
    assert report["0"]["precision"] == pytest.approx(c["tn"] / (c["tn"] + c["fn"]))


def test_empty_bases_give_zero(spark):
    none = spark.createDataFrame([], "converted int, probability_1 double, prediction int")
    row = metrics.classification_metrics(metrics.confusion_counts(none)).first()
    assert tuple(row) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    assert metrics.threshold_sweep(none).count() == 7


def test_best_threshold_prefers_the_lowest_of_equals(spark):
    frame = spark.createDataFrame(
        [(0.3, 0.5), (0.2, 0.5), (0.4, 0.1)], "threshold double, f1 double")
    assert metrics.best_threshold(frame).first()["threshold"] == 0.2


def test_overview_and_funnel(spark):
    frame = spark.createDataFrame([(1, 0), (1, 0), (0, 1), (1, 0)], "is_abandoned int, converted int")
    assert tuple(kpis.overview_kpis(frame).first()) == (4, 3, 1, 75.0, 25.0)
    assert tuple(kpis.overview_kpis(frame.limit(0)).first()) == (0, 0, 0, 0.0, 0.0)
    steps = spark.createDataFrame([("cart", 3), ("purchase", 2)], "event_type string, count long")
    row = kpis.funnel_rates(steps).first()
    assert row["view_to_cart"] == 0.0 and row["total_events"] == 5
    assert row["cart_to_purchase"] == pytest.approx(200 / 3)


def test_areas_equal_the_evaluators_at_every_score(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    score = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = spark.range(5000).withColumn("probability_1", F.when(F.col("id") % 7 == 0, F.lit(0.25)).otherwise(score))
    rows = rows.withColumn("converted", F.when(F.rand(3) * 0.7 + 0.15 < F.col("probability_1"), 1).otherwise(0))
    both = rows.withColumn("model", F.lit("a")).unionByName(
        rows.withColumns({"model": F.lit("b"), "probability_1": 1 - F.col("probability_1")})).cache()
    found = {r["model"]: r for r in metrics.curve_areas(metrics.score_counts(both, model="model"), ["model"]).collect()}
    for name in ("a", "b"):
        for metric, column in (("areaUnderROC", "roc_auc"), ("areaUnderPR", "pr_auc")):
            judge = BinaryClassificationEvaluator(
                labelCol="converted", rawPredictionCol="probability_1", metricName=metric, numBins=0)
            assert abs(judge.evaluate(both.filter(F.col("model") == name)) - found[name][column]) < 1e-9
    assert found["a"]["roc_auc"] > 0.7 > 0.3 > found["b"]["roc_auc"]


def test_areas_without_one_class_and_without_rows(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, None), (1, 0.7)], "converted int, probability_1 double")
    assert metrics.curve_areas(metrics.score_counts(rows)).first()["roc_auc"] == 0.0
    empty = metrics.curve_areas(metrics.score_counts(rows.limit(0), model="converted"), ["model"])
    assert empty.collect() == []
