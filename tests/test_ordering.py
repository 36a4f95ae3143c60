import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierblend.operators import ordering, splits


def _frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ID bigint, x double")


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 40, [float(i % 3) for i in range(100)], [random.Random(1).gauss(0, 1) for _ in range(500)],
    [7.0] * 300 + [float(i) for i in range(100)],
])
def test_exact_quantiles_equal_numpy(spark, values):
    probs = [0.0, 0.1, 0.5, 0.8, 0.99, 1.0]
    got = ordering.exact_quantiles(_frame(spark, values), "x", probs)
    assert got == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)


def test_quantile_skips_missing_and_handles_empty(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 3.0)], "ID bigint, x double")
    assert ordering.exact_quantiles(df, "x", [0.5]) == [2.0]
    assert ordering.exact_quantiles(df.filter("ID > 9"), "x", [0.5]) == [None]


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_row_numbers_follow_the_key(spark, kind):
    df = spark.range(777).select((F.col("id") * 37 % 1009).cast(kind).alias("k")).repartition(5)
    rows = ordering.with_row_number(df, "k").collect()
    assert sorted(r["ID"] for r in rows) == list(range(777))
    by_key = sorted(rows, key=lambda r: r["k"])
    assert [r["ID"] for r in by_key] == list(range(777))


def test_row_numbers_of_empty_table(spark):
    assert ordering.with_row_number(spark.range(0).withColumnRenamed("id", "k"), "k").count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 100, 1003])
def test_folds_partition_and_balance(spark, n):
    df = spark.range(n).select(F.col("id").alias("ID"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    rows = splits.stratified_folds(df, "y", "ID", 5).collect()
    assert len(rows) == n
    for label in (0, 1):
        sizes = [sum(1 for r in rows if r["y"] == label and r["fold"] == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
        assert sum(sizes) == sum(1 for r in rows if r["y"] == label)


def test_folds_with_more_groups_than_constants(spark, monkeypatch):
    df = spark.range(900).select(F.col("id").alias("ID"), (F.col("id") % 30).alias("y"))
    direct = {r["ID"]: r["fold"] for r in splits.stratified_folds(df, "y", "ID", 3).collect()}
    monkeypatch.setattr(ordering, "small_rows", lambda df, limit=0: None)
    joined = {r["ID"]: r["fold"] for r in splits.stratified_folds(df, "y", "ID", 3).collect()}
    assert direct == joined


@pytest.mark.parametrize("n,share,expect", [(10, 0.2, 2), (11, 0.2, 3), (399, 0.2, 80), (1, 0.5, 1), (5, 0.0, 0), (5, 1.0, 5)])
def test_random_split_has_the_exact_size(spark, n, share, expect):
    df = spark.range(n).withColumnRenamed("id", "ID")
    assert splits.random_split(df, "ID", share).filter("is_test").count() == expect


def test_random_split_does_not_depend_on_partitioning(spark):
    df = spark.range(200).withColumnRenamed("id", "ID")
    a = {r["ID"] for r in splits.random_split(df, "ID", 0.3, 5).filter("is_test").collect()}
    b = {r["ID"] for r in splits.random_split(df.repartition(7), "ID", 0.3, 5).filter("is_test").collect()}
    c = {r["ID"] for r in splits.random_split(df, "ID", 0.3, 6).filter("is_test").collect()}
    assert a == b != c


def test_three_way_sizes(spark):
    df = spark.range(1003).withColumnRenamed("id", "ID")
    sizes = {r["part"]: r["count"] for r in splits.three_way_holdout(df, "ID").groupBy("part").count().collect()}
    assert sizes == {"train": 802, "ptrain": 100, "ptest": 101}


def test_complement(spark):
    df = spark.range(10).withColumnRenamed("id", "ID")
    assert sorted(r[0] for r in splits.complement(df, df.filter("ID < 7"), "ID").collect()) == [7, 8, 9]


def test_split_moves_no_rows(spark):
    """The split itself is a comparison with constants: its plan has no exchange."""
    df = spark.range(1000).withColumnRenamed("id", "ID")
    plan = splits.random_split(df, "ID", 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
