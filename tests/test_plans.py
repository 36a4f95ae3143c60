import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tierblend.catalog.fixtures import basket_vectors
from tierblend.operators import encode, splits, trees
from tierblend.operators.metrics import roc_auc
from tierblend.plans import learners, search, two_level
from tierblend.sources import sinks, tables

TREES = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3, "min_samples_leaf": 8}


@pytest.fixture(scope="module")
def data(spark, sf):
    marked = splits.random_split(basket_vectors(spark, sf), "ID", 0.25)
    table = learners.fold_table(marked.filter("not is_test").drop("is_test"), 3)
    return table, marked.filter("is_test").drop("is_test").cache()


def test_grid_order_and_sampling():
    grid = search.expand_grid({"b": [1, 2], "a": ["x", "y"]})
    assert grid == [{"a": "x", "b": 1}, {"a": "x", "b": 2}, {"a": "y", "b": 1}, {"a": "y", "b": 2}]
    drawn = search.sample_configs({"d": ("quniform", 6, 9, 1), "s": ("uniform", 0.5, 1.0), "n": 400}, 201)
    assert drawn == search.sample_configs({"d": ("quniform", 6, 9, 1), "s": ("uniform", 0.5, 1.0), "n": 400}, 201)
    assert {c["d"] for c in drawn} == {6, 7, 8, 9} and all(0.5 <= c["s"] < 1.0 and c["n"] == 400 for c in drawn)


def test_best_config_direction_and_ties(spark):
    rows = [(c, f, m, s) for c, s in ((0, 0.5), (1, 0.9), (2, 0.9), (3, 0.1)) for f in (0, 1) for m in ("auc", "log_loss")]
    df = spark.createDataFrame(rows, "cfg int, fold int, metric string, score double")
    assert search.best_config(df, "auc").first()["cfg"] == 1
    assert search.best_config(df, "log_loss").first()["cfg"] == 3


@pytest.mark.parametrize("learner,config", [
    (learners.logistic_learner("l2"), {"C": 1.0}),
    (learners.hinge_svm_learner(), {"C": 1.0}),
    (learners.L1SvmLearner(), {"C": 1.0}),
    (learners.KnnLearner(), {"n_neighbors": 5, "weights": "distance"}),
    (learners.boosting_learner(), TREES),
], ids=["logistic", "hinge", "l1svm", "knn", "boosting"])
def test_out_of_fold_covers_every_row_once(data, learner, config):
    table, test = data
    fitted = learner.fit(table, [config], whole=True)
    oof = fitted.out_of_fold([0]).cache()
    n = table.df.count()
    assert oof.count() == n and oof.select("ID").distinct().count() == n
    ends = oof.agg(F.min("p"), F.max("p")).first()
    assert 0.0 <= ends[0] <= ends[1] <= 1.0
    folds = oof.join(table.df.select("ID", F.col("fold").alias("f")), "ID").filter("f <> fold").count()
    assert folds == 0
    assert roc_auc(oof, "label", "p").first()["auc"] > 0.6
    assert fitted.score(test, [0]).count() == test.count()


def test_scored_rows_were_not_seen(spark, data):
    """A one-neighbour vote would be perfect on seen rows with random labels; it must not be."""
    table, _ = data
    noise = table.df.withColumn("label", F.pmod(F.xxhash64("ID"), F.lit(2)).cast("double")).cache()
    shuffled = learners.FoldedTable(noise, counts=table.counts)
    oof = learners.KnnLearner().fit(shuffled, [{"n_neighbors": 1, "weights": "uniform"}]).out_of_fold([0])
    share = oof.agg(F.avg((F.col("p") == F.col("label")).cast("double"))).first()[0]
    assert 0.35 < share < 0.65


def test_search_keeps_predictions_and_picks_by_metric(spark, data, tmp_path):
    table, _ = data
    path = str(tmp_path / "preds")
    found = search.grid_search(learners.logistic_learner("l2"), table, {"C": [1e-5, 1.0]}, "log_loss", keep=path)
    assert found.best_params == {"C": 1.0}
    assert spark.read.parquet(path).groupBy("cfg").count().filter(F.col("count") == table.df.count()).count() == 2
    assert found.scores.count() == 2 * 3 * 7
    assert found.out_of_fold().count() == table.df.count()
    wide = search.result_table(found.scores, "log_loss", table.folds)
    assert wide.columns == ["cfg", "score_0", "score_1", "score_2", "score_mean", "score_std"]


def test_leaf_codes_have_one_active_position_per_tree(data):
    table, test = data
    coded, other, model = learners.encode_leaves(table, test, TREES)
    n_trees = model.getNumTrees
    for df in (coded.df, other):
        sizes = df.select(F.size(F.unwrap_udt("features")["indices"]).alias("n")).distinct().collect()
        assert [r["n"] for r in sizes] == [n_trees]


def test_unseen_leaves_give_no_position(data):
    table, test = data
    model = trees.boosted_trees(TREES).fit(table.df.select("label", "features"))
    hot = encode.fit_leaf_one_hot(model.transform(table.df))
    cut = encode.LeafOneHotModel(tuple(v for v in hot.vocabulary if not v.startswith("0:")))
    sizes = cut.transform(model.transform(test)).select(F.size(F.unwrap_udt("leaf_onehot")["indices"])).distinct().collect()
    assert [r[0] for r in sizes] == [model.getNumTrees - 1]


def test_nested_encoding_scores_every_row(data):
    table, _ = data
    oof = learners.nested_leaf_scores(table, TREES, learners.logistic_learner("l2"), {"C": 1.0})
    assert oof.count() == table.df.count()
    assert roc_auc(oof, "label", "p").first()["auc"] > 0.7


def test_blend_is_no_worse_than_the_worst_model(spark, data):
    table, test = data
    pair = [
        two_level.Candidate("lr", learners.logistic_learner("l2"), {"C": [1.0]}),
        two_level.Candidate("leaf_svm", learners.L1SvmLearner(), {"C": [0.1]}, on_leaves=True),
    ]
    # about a hundred rows fit the blend, so only penalties that leave them a say are offered
    level1, blend = two_level.run_stack(table, test, pair, TREES, alphas=(0.01, 0.1, 1.0))
    assert level1.meta_train.count() == table.df.count() and level1.meta_test.count() == test.count()
    worst = min(
        level1.meta_test.agg(F.avg(((F.col(c) >= 0.5) == (F.col("label") == 1)).cast("double"))).first()[0] for c in level1.columns
    )
    assert blend.evaluation.first()["accuracy"] >= worst - 0.02
    assert blend.weights.columns == ["intercept", "meta_lr", "meta_leaf_svm"]
    report = two_level.run_report(level1, blend)
    text = sinks.report_frame(spark, report).first()[0]
    assert text.index('"level1"') < text.index('"level2"') < text.index('"result"')


def test_model_and_encoded_table_round_trip(spark, data, tmp_path):
    table, test = data
    model = trees.boosted_trees(TREES).fit(table.df.select("label", "features"))
    sinks.save_model(model, str(tmp_path / "model"))
    again = tables.load_model(str(tmp_path / "model"))
    a = model.transform(test).select("ID", vector_to_array("probability")[1].alias("p"))
    b = again.transform(test).select("ID", vector_to_array("probability")[1].alias("q"))
    assert a.join(b, "ID").filter("p <> q").count() == 0
    coded, _, _ = learners.encode_leaves(table, None, TREES)
    coded.df.write.parquet(str(tmp_path / "codes"))
    assert spark.read.parquet(str(tmp_path / "codes")).exceptAll(coded.df).count() == 0
