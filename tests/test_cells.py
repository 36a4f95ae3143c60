"""Tree fits on rows grouped by the bins of their features."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tierblend.plans import learners, search


def _measure(k, m):
    return F.pmod(F.xxhash64(F.lit(k), "ID"), F.lit(m)).cast("double")


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(24_000).withColumnRenamed("id", "ID").select(
        "ID", _measure(1, 12).alias("a"), (_measure(2, 9) / 4).alias("b"), F.lit(3.0).alias("c"), _measure(3, 10).alias("u"))
    label = ((F.col("a") > 6) & (F.col("b") > 0.7) | (F.col("u") == 0)).cast("double")
    return learners.fold_table(df.select("ID", label.alias("label"), array_to_vector(F.array("a", "b", "c")).alias("features")))


def test_few_cells_stand_for_all_rows(table):
    """Fits see at most one row per label and cell, and score as fits on single rows do; leaves count rows, not cells."""
    configs = search.expand_grid({"n_estimators": [2, 4], "max_depth": [3], "max_leaf_nodes": [3, 6], "min_samples_leaf": [40]})
    learner = learners.boosting_learner()
    found = learner.fit(table, configs)
    assert found.cells[0].df.count() <= 2 * 12 * 9
    assert found.cells[0].df.agg(F.sum(learners.COUNT)).first()[0] == 24_000
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(learners, "PIECES", 10**9)
        single = learner.fit(table, configs)
    assert single.cells == [None]
    on = ["cfg", "fold", "ID", "label"]
    both = found.out_of_fold(range(4)).alias("x").join(single.out_of_fold(range(4)).alias("y"), on)
    rows, most = both.agg(F.count("*"), F.max(F.abs(F.col("x.p") - F.col("y.p")))).first()
    assert rows == 4 * 24_000 and most < 1e-9


def test_scores_of_other_rows(table):
    """Rows that were not grouped get the scores of their cells, and keep their own features."""
    configs = search.expand_grid({"n_estimators": [4], "max_depth": [2, 3], "min_samples_leaf": [40]})
    found = learners.forest_learner().fit(table, configs)
    assert all(found.cells)
    at = found.attach(table.only(1), 1, 1, "z")
    assert at.select(*table.df.columns).exceptAll(table.only(1)).isEmpty()
    both = at.join(found.out_of_fold([0, 1]).where("cfg = 1 and fold = 1").select("ID", "p"), "ID")
    assert both.agg(F.count("*"), F.max(F.abs(F.col("z") - F.col("p")))).first()[1] == 0.0
    assert both.count() == table.only(1).count()


def test_continuous_features_are_not_grouped(spark):
    df = spark.range(24_000).select(F.col("id").alias("ID"), F.pmod("id", F.lit(2)).cast("double").alias("label"),
                                    array_to_vector(F.array(*[F.rand(i) for i in range(5)])).alias("features"))
    assert learners._cells(learners.fold_table(df), 32) is None
