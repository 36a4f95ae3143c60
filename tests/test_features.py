import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tierblend.functions.columns import binary_label, log1p_float
from tierblend.operators import encode, joins, scale, select


def test_label_and_log(spark):
    df = spark.createDataFrame([(" >50K", 0.0), (" <=50K", 9.0), (None, -5.0)], "t string, x double")
    got = df.select(binary_label("t", ">50K").alias("y"), log1p_float("x").alias("l")).collect()
    assert [r["y"] for r in got] == [1, 0, 0]
    assert got[0]["l"] == 0.0 and got[1]["l"] == pytest.approx(math.log(10), rel=1e-6) and got[2]["l"] is None


def test_one_hot_is_fit_on_the_union_and_ignores_unknown(spark):
    a = spark.createDataFrame([(1, "x", "u"), (2, "y", None)], "ID bigint, c string, e string")
    b = spark.createDataFrame([(3, "z", "u"), (4, "new", "u")], "ID bigint, c string, e string")
    model = encode.fit_one_hot([a, b.filter("ID = 3")], ["c", "e"])
    assert model.names == ("c=x", "c=y", "c=z", "e=u")
    rows = {r["ID"]: tuple(r)[1:] for r in model.transform(a.unionByName(b)).collect()}
    assert rows == {1: (1, 0, 0, 1), 2: (0, 1, 0, 0), 3: (0, 0, 1, 1), 4: (0, 0, 0, 1)}
    sparse = {r["ID"]: tuple(r["onehot"].toArray()) for r in model.transform_sparse(a.unionByName(b)).collect()}
    assert sparse == rows
    long = {(r["ID"], r["name"], r["index"]) for r in encode.one_hot_long(a, [a, b], ["c", "e"], "ID").collect()}
    assert long == {(1, "c=x", 1), (1, "e=u", 4), (2, "c=y", 2)}
    with pytest.raises(ValueError):
        encode.fit_one_hot([a], ["c"], limit=1)


def test_factorize(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b"), (4, "c")], "ID bigint, c string")
    out = encode.fit_factorize(df, ["c"], "ID").transform(df).orderBy("ID").collect()
    assert [r["c"] for r in out] == [0, 1, -1, 0, 2]


def test_lookup_join_splits_hot_keys(spark):
    df = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") < 400, F.lit("hot")).when(F.col("id") % 10 == 0, None).otherwise(F.col("id").cast("string")).alias("k")
    )
    table = df.select("k").filter("k is not null").distinct().withColumn("v", F.length("k"))
    a = {tuple(r) for r in joins.lookup_join(df, table, "k").select("id", "k", "v").collect()}
    b = {tuple(r) for r in joins.lookup_join(df, table, "k", limit=5).select("id", "k", "v").collect()}
    assert len(a) == 1000 and a == b


def test_constants_and_identicals(spark):
    rows = [(i, float(i), 1, i, float("nan") if i == 3 else 1.0 * i, None if i == 2 else i, str(i), str(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "ID bigint, a double, k int, b int, n double, m int, s string, t string")
    cols = ["a", "k", "b", "n", "m", "s", "t"]
    kept, gone = select.drop_constants(df, cols)
    assert gone == ["k"] and "k" not in kept.columns
    kept, gone = select.drop_identicals(df, cols, "ID")
    assert gone == ["b", "t"]  # equal values of another number type; columns with gaps never match
    same = df.select("ID", "n", F.col("n").alias("n2"))
    assert select.identical_columns(same, ["n", "n2"], "ID") == []


def test_fingerprint_collisions_are_checked(spark, monkeypatch):
    df = spark.createDataFrame([(i, i, i + 1, i, i + 1) for i in range(5)], "ID bigint, a int, b int, c int, d int")
    monkeypatch.setattr(select.F, "xxhash64", lambda *c: F.lit(1).cast("bigint"))
    assert select.identical_columns(df, ["a", "b", "c", "d"], "ID") == ["c", "d"]


def test_scaling_of_constants_and_fit_on(spark):
    train = spark.createDataFrame([(1, 0.0, 5.0), (2, 10.0, 5.0)], "ID bigint, x double, c double")
    test = spark.createDataFrame([(3, 5.0, 6.0), (4, 20.0, 5.0)], "ID bigint, x double, c double")
    _, a = scale.scale_pair(train, test, ["x", "c"])
    assert [tuple(r) for r in a.orderBy("ID").collect()] == [(3, 0.5, 1.0), (4, 2.0, 0.0)]
    _, b = scale.scale_pair(train, test, ["x", "c"], fit_on="each")
    assert [tuple(r) for r in b.orderBy("ID").collect()] == [(3, 0.0, 1.0), (4, 1.0, 0.0)]
    s, _ = scale.scale_pair(train, test, ["x", "c"], scale.fit_standard)
    assert [tuple(r)[1:] for r in s.orderBy("ID").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_row_statistics(spark):
    df = spark.createDataFrame([(7, 1.0, 2, None, 1), (8, None, None, None, 0)], "ID bigint, a double, b int, c double, TARGET int")
    one, none = scale.row_statistics(df).orderBy("ID").collect()
    assert (one["mean"], one["sum_col_val"], one["max_col_val"], one["min_col_val"]) == (1.5, 3.0, 2.0, 1.0)
    assert one["std"] == pytest.approx(math.sqrt(0.5))
    assert none["mean"] is None and none["sum_col_val"] == 0.0
    whole = scale.row_statistics(df, exclude=()).orderBy("ID").first()
    assert whole["sum_col_val"] == 11.0


def test_pca_scores_are_centred_and_uncorrelated(spark):
    rows = [(i, math.sin(i), math.sin(i) * 2 + math.cos(3 * i), math.cos(i * i)) for i in range(200)]
    df = spark.createDataFrame(rows, "ID bigint, a double, b double, c double")
    model = scale.fit_pca(df, ["a", "b", "c"], 2)
    out = model.transform(df)
    m = out.agg(F.avg("pc1"), F.corr("pc1", "pc2"), F.var_samp("pc1"), F.var_samp("pc2")).first()
    total = df.agg(F.var_samp("a") + F.var_samp("b") + F.var_samp("c")).first()[0]
    assert m[0] == pytest.approx(0, abs=1e-9) and m[1] == pytest.approx(0, abs=1e-9)
    assert [m[2] / total, m[3] / total] == pytest.approx(model.explained, abs=1e-9)
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df)
    other = scale.fit_pca_vector(vec, "v", 2).transform_vector(vec, "v")
    gap = out.join(other.select("ID", "pca"), "ID").agg(F.max(F.abs(F.col("pc1") - F.col("pca")[0]))).first()[0]
    assert gap < 1e-9


def test_combine_reports_gaps_and_duplicates(spark):
    a = spark.createDataFrame([(1, 0.1, 0), (2, 0.2, 1)], "ID bigint, p double, label int")
    b = spark.createDataFrame([(1, 0.3, 0), (2, 0.4, 1)], "ID bigint, p double, label int")
    got = sorted(tuple(r) for r in joins.combine_columns({"ma": a, "mb": b}, "ID", "label").collect())
    assert got == [(1, 0.1, 0.3, 0), (2, 0.2, 0.4, 1)]
    for bad in (b.filter("ID = 1"), b.unionByName(b.filter("ID = 1"))):
        with pytest.raises(Exception, match="exactly one score"):
            joins.combine_columns({"ma": a, "mb": bad}, "ID", "label").collect()


def test_submission_needs_equal_keys(spark):
    ids = spark.createDataFrame([(1,), (2,)], "ID bigint")
    preds = spark.createDataFrame([(1, 0.5), (2, 0.25)], "ID bigint, p double")
    assert sorted(tuple(r) for r in joins.submission(ids, preds, "ID", "p").collect()) == [(1, 0.5), (2, 0.25)]
    for left, right in ((ids, preds.filter("ID = 1")), (ids.filter("ID = 1"), preds)):
        with pytest.raises(Exception, match="differ"):
            joins.submission(left, right, "ID", "p").collect()
