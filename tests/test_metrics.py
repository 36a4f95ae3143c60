import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tierblend.operators import metrics, profile, scores


def _scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "label int, p double")


def _auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    won = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return won / (len(pos) * len(neg))


CASES = [
    [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)],
    [(1, 0.9), (0, 0.1)],
    [(i % 2, random.Random(i).random()) for i in range(300)],
    [(i % 3 == 0, 0.7 if i % 3 else round(random.Random(i).random(), 1)) for i in range(300)],
]


@pytest.mark.parametrize("pairs", CASES)
def test_auc_equals_pair_counting(spark, pairs):
    df = _scored(spark, pairs)
    assert metrics.roc_auc(df, "label", "p").first()["auc"] == pytest.approx(_auc(pairs), abs=1e-12)
    turned = df.withColumn("p", 1 - F.col("p"))
    assert metrics.roc_auc(turned, "label", "p").first()["auc"] == pytest.approx(1 - _auc(pairs), abs=1e-9)


def test_auc_equals_evaluator(spark):
    df = _scored(spark, CASES[2])
    tool = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0)
    assert metrics.roc_auc(df, "label", "p").first()["auc"] == pytest.approx(tool.evaluate(df), abs=1e-9)


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(_scored(spark, [(1, 0.2), (1, 0.4)]), "label", "p").first()["auc"] is None


def test_report_has_both_conventions(spark):
    df = spark.createDataFrame([(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(1, 1)] * 4, "y int, yhat int")
    r = metrics.classification_report(df, "y", "yhat").first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (5, 2, 1, 4)
    assert r["accuracy"] == pytest.approx(9 / 12)
    assert r["precision"] == pytest.approx(4 / 6) and r["recall"] == pytest.approx(4 / 5)
    # with the matrix read as [[TP, FP], [FN, TN]]
    p, q = 5 / 7, 5 / 6
    assert r["precision_class0_swapped"] == pytest.approx(p) and r["recall_class0_swapped"] == pytest.approx(q)
    assert r["f_class0_swapped"] == pytest.approx(2 * p * q / (p + q))


def test_losses_at_the_ends(spark):
    df = _scored(spark, [(1, 0.0), (0, 1.0), (1, 1.0), (0, 0.0)])
    got = df.agg(metrics.hinge_loss("label", "p").alias("h"), metrics.log_loss("label", "p").alias("l")).first()
    assert got["h"] == pytest.approx((1 + 2 + 0 + 1) / 4)
    assert got["l"] == pytest.approx(-2 * math.log(1e-15) / 4, rel=1e-3)


def test_no_predicted_positive_gives_null_precision(spark):
    r = metrics.classification_report(spark.createDataFrame([(1, 0), (0, 0)], "y int, p int"), "y", "p").first()
    assert r["precision"] is None and r["recall"] == 0.0


def test_minmax_per_batch(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, 5.0), (0, 2.0)], "fold int, s double")
    got = sorted((r["fold"], r["p"]) for r in scores.minmax_calibrate(df, "s", "p", ["fold"]).collect())
    assert got == [(0, 0.0), (0, 0.5), (0, 1.0), (1, 0.0), (1, 0.0)]
    assert [r["p"] for r in scores.minmax_calibrate(df, "s").orderBy("s").collect()] == [0.0, 0.25, 0.5, 1.0, 1.0]


def test_histogram_and_cdf(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    h = profile.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 2, 2, 2, 3]
    assert sum(r["density"] * (r["right"] - r["left"]) for r in h) == pytest.approx(1.0)
    assert [r["cdf"] for r in profile.cumulative(profile.histogram(df, "x", 5)).orderBy("bin").collect()][-1] == 1.0
    assert profile.histogram(df.withColumn("x", F.lit(2.0)), "x", 4).agg(F.sum("n")).first()[0] == 11
    assert profile.histogram(df.filter("x > 99"), "x", 4).count() == 4


def test_quantile_filter_needs_more_than_twenty_rows(spark):
    few = spark.createDataFrame([(float(i),) for i in range(20)], "score double")
    assert profile.keep_upper_scores(few, "score").count() == 20
    many = spark.createDataFrame([(float(i),) for i in range(21)], "score double")
    assert sorted(r[0] for r in profile.keep_upper_scores(many, "score").collect()) == [17.0, 18.0, 19.0, 20.0]
