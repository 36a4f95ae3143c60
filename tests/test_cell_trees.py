"""Boosted trees fitted one per task on cells, and the searches that use them."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tierblend.operators import cell_trees
from tierblend.plans import learners, search


def rows(spark, n, seed=3):
    """Few values per feature; the label follows two of them."""
    x = [F.floor(F.rand(seed + i) * k).cast("double") for i, k in enumerate((6, 9, 4))]
    wide = spark.range(n).select(F.col("id").alias("ID"), *[c.alias(f"x{i}") for i, c in enumerate(x)], F.rand(seed + 9).alias("u"))
    label = ((F.col("x0") > 2) & (F.col("x1") < 5)) != (F.col("u") < 0.1)
    return wide.select("ID", label.cast("double").alias("label"), array_to_vector(F.array("x0", "x1", "x2")).alias("features"))


GRID = {"n_estimators": [3, 8], "max_depth": [3], "learning_rate": [0.3], "max_leaf_nodes": [None, 4], "min_samples_leaf": [8]}


def test_fits_in_tasks_are_those_of_spark(spark, monkeypatch):
    table = learners.fold_table(rows(spark, 24_000), 3)
    learner, configs = learners.boosting_learner(), search.expand_grid(GRID)
    fitted = learner.fit(table, configs)
    assert isinstance(fitted, learners._FittedCells)
    got = fitted.out_of_fold(range(4)).toPandas().set_index(["cfg", "ID"])["p"].sort_index()
    monkeypatch.setattr(cell_trees, "HELD", 0)
    plain = learner.fit(table, configs)
    assert isinstance(plain, learners._FittedTrees)
    want = plain.out_of_fold(range(4)).toPandas().set_index(["cfg", "ID"])["p"].sort_index()
    assert len(got) == 4 * 24_000 and (got.index == want.index).all()
    assert np.abs(got - want).max() < 1e-6


def test_sampling_draws_rows_of_a_cell_one_by_one():
    bins = np.array([[0], [1], [2], [3]])
    s = cell_trees.Settings(trees=1, depth=1, rate=0.1, least=1, subsample=0.5, features=1, seed=7)
    read, _ = cell_trees.fit(bins, np.array([0.0, 0, 1, 1]), np.array([10_000] * 4), s)
    assert 19_500 < read.rows[0][0] < 20_500 and read.trees[0][0].feature == 0
    assert [v for _, v in read.leaves()[0]] == [-1.0, 1.0]


def test_many_fits_of_a_small_table_run_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(learners, "MANY_FITS", 6)
    table = learners.fold_table(rows(spark, 600), 3)
    found = search.sampled_search(learners.boosting_learner(), table, {"max_depth": ("quniform", 2, 4, 1), "n_estimators": 4,
                                                                       "learning_rate": ("uniform", 0.1, 0.3)}, trials=5)
    assert search.top_configs(found.scores, "auc", use_lower=True).count() == 5
    assert search.top_configs(found.scores, "auc", 2, use_lower=True).count() == 2
    assert found.best_score > 0.8
