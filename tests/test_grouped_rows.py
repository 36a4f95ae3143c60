"""Linear fits on leaf codes see equal rows once, with their count."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tierblend.operators import margins
from tierblend.plans import learners


@pytest.fixture(scope="module")
def codes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(4000):
        at = [int(rng.integers(3)), 3 + int(rng.integers(2)), 5 + int(rng.integers(3))]
        label = float(rng.random() < (0.8 if at[0] == 0 else 0.25) + (0.1 if at[2] == 6 else 0.0))
        rows.append((i, label, Vectors.sparse(8, at, [1.0] * 3), i % 5))
    df = spark.createDataFrame(rows, ["ID", "label", "features", "fold"]).cache()
    return learners.FoldedTable(df, counts=tuple((f, 800) for f in range(5)))


def test_equal_codes_are_one_row_per_piece(codes, monkeypatch):
    assert learners._group_rows(codes) is None  # too few rows to be worth it
    monkeypatch.setattr(learners, "PIECES", 100)
    rows = learners._group_rows(codes)
    assert rows.count() <= 18 * 2 * 5 + 100
    assert rows.agg(F.max(learners.WEIGHT)).first()[0] <= 40
    per_fold = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.sum(learners.WEIGHT).alias("n")).collect()}
    assert per_fold == pytest.approx(dict(codes.counts))


def test_fits_on_grouped_rows_equal_those_on_single_rows(codes, monkeypatch):
    monkeypatch.setattr(learners, "PIECES", 200)
    grouped = replace(codes, grouped=learners._group_rows(codes))
    for learner in (learners.logistic_learner("l2"), learners.logistic_learner("l1"), learners.L1SvmLearner()):
        a, b = (learner.fit(t, [{"C": 0.1}], whole=True).models for t in (codes, grouped))
        for key in a:
            one, two = ([*getattr(m, "weights", None)] if hasattr(m, "weights") else m.coefficients.toArray() for m in (a[key], b[key]))
            assert np.allclose(one, two, atol=2e-3), (learner, key)


def test_fits_read_the_grouped_rows(codes, monkeypatch):
    monkeypatch.setattr(learners, "PIECES", 200)
    grouped, seen = replace(codes, grouped=learners._group_rows(codes)), []
    build = lambda p, n: type("Spy", (), {
        "hasParam": lambda self, name: name == "weightCol", "setWeightCol": lambda self, name: self,
        "fit": lambda self, df: seen.append((n, df.columns, df.count()))})()
    learners.SparkLearner(build).fit(grouped, [{}])
    assert len(seen) == 5 and all(n == 3200 and learners.WEIGHT in columns and rows < 800 for n, columns, rows in seen)


def test_weights_stand_for_repeated_rows(spark):
    rows = [(Vectors.dense([1.0, 0.0]), 1.0, 0, 3), (Vectors.dense([0.5, 1.0]), 0.0, 0, 2), (Vectors.dense([0.0, 1.0]), 1.0, 1, 1),
            (Vectors.dense([0.2, 0.3]), 0.0, 1, 4)]
    df = spark.createDataFrame(rows, ["features", "label", "fold", "n"])
    single = df.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    a, b = margins.fit_l1_svm(single, [1.0], fold="fold"), margins.fit_l1_svm(df, [1.0], fold="fold", weight="n")
    for key in a:
        assert np.allclose(a[key].weights, b[key].weights, atol=1e-9) and a[key].intercept == pytest.approx(b[key].intercept)
