import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tierblend.catalog.fixtures import BASKET_COLUMNS, basket_vectors
from tierblend.operators import encode, nodes, splits, trees
from tierblend.plans import learners, search, two_level

DEEP = {"n_estimators": 6, "max_depth": 4, "learning_rate": 0.3, "subsample": 0.8, "min_samples_leaf": 5, "random_state": 3}


@pytest.fixture(scope="module")
def data(spark, sf):
    marked = splits.random_split(basket_vectors(spark, sf), "ID", 0.25)
    table = learners.fold_table(marked.filter("not is_test").drop("is_test"), 3)
    return table, marked.filter("is_test").drop("is_test").cache()


@pytest.fixture(scope="module")
def boosted(data):
    return trees.boosted_trees(DEEP).fit(data[0].df.select("label", "features"))


def differs(a, b, column="p"):
    joined = a.select("ID", F.col(column).alias("x")).join(b.select("ID", F.col(column).alias("y")), "ID")
    return joined.filter(F.abs(F.col("x") - F.col("y")) > 1e-9).count()


def test_prefix_of_a_fit_equals_a_short_fit(spark, data, boosted):
    table, test = data
    read = nodes.ensemble(boosted, spark)
    scored = nodes.with_leaves(boosted, test).withColumn("s", read.scores(F.col("leaf"), [1, 3, 6])).cache()
    for at, n in enumerate((1, 3, 6)):
        short = trees.boosted_trees(DEEP | {"n_estimators": n}).fit(table.df.select("label", "features")).transform(test)
        assert differs(scored.select("ID", F.col("s")[at].alias("p")), short.select("ID", vector_to_array("probability")[1].alias("p"))) == 0


def test_forest_scores_equal_the_model(spark, data):
    table, test = data
    model = trees.random_forest({"n_estimators": 5, "max_depth": 3, "criterion": "entropy"}).fit(table.df.select("label", "features"))
    mine = nodes.with_leaves(model, test).select("ID", F.get(nodes.ensemble(model, spark).scores(F.col("leaf"), [5]), F.lit(0)).alias("p"))
    assert differs(mine, model.transform(test).select("ID", vector_to_array("probability")[1].alias("p"))) == 0


@pytest.mark.parametrize("cap", [2, 3, 5, 100])
def test_cap_on_leaves(spark, boosted, cap):
    read = nodes.ensemble(boosted, spark)
    full = read.leaves()
    for capped, whole, tree in zip(read.leaves(cap), full, read.trees):
        numbers = [k for k, _ in capped]
        assert len(capped) == len(whole) and numbers == sorted(numbers)
        assert len(set(numbers)) == min(cap, len(whole))
        assert all(v in {n.value for n in tree} for _, v in capped)
    if cap >= 16:
        assert read.leaves(cap) == full


def test_codes_have_one_position_per_tree(spark, data, boosted):
    _, test = data
    hot = encode.LeafCodes(nodes.ensemble(boosted, spark), 4)
    _, size = hot.positions(F.col("leaf"))
    assert size == 6 * 4
    rows = hot.transform(nodes.with_leaves(boosted, test)).select(F.unwrap_udt("leaf_onehot")["indices"].alias("i")).distinct().collect()
    assert all([i // 4 for i in r["i"]] == list(range(6)) for r in rows)


def test_split_counts_cover_all_inner_nodes(spark, boosted):
    table = nodes.node_table(boosted, spark).cache()
    total = table.filter("feature is not null").count()
    assert nodes.split_counts(table, BASKET_COLUMNS).agg(F.sum("splits")).first()[0] == total
    assert nodes.split_counts(table, BASKET_COLUMNS, 0).count() == 0


def test_unknown_settings_are_refused():
    with pytest.raises(ValueError, match="n_estimatorz"):
        trees.boosted_trees({"n_estimatorz": 5})
    with pytest.raises(ValueError):
        trees.boosted_trees({"max_leaf_nodes": 1})
    with pytest.raises(ValueError):
        trees.boosted_trees({"loss": "exponential"})


def test_settings_share_fits(data):
    table, test = data
    fits = []

    def build(p, label):
        fits.append(p)
        return trees.boosted_trees(p, label=label)

    grid = {"n_estimators": [2, 4], "max_leaf_nodes": [3, 16], "max_depth": [3], "learning_rate": [0.1, 0.3]}
    configs = search.expand_grid(grid)
    fitted = learners.TreeLearner(build).fit(table, configs, whole=True)
    assert len(fits) == 2 * 4 and {p["n_estimators"] for p in fits} == {4}
    oof = fitted.out_of_fold(range(8)).cache()
    assert oof.groupBy("cfg").count().filter(F.col("count") != table.df.count()).count() == 0
    assert oof.select("cfg").distinct().count() == 8
    scored = fitted.score(test, [0, 5]).cache()
    assert scored.count() == 2 * test.count()
    assert differs(scored.filter("cfg = 5").drop("cfg"), fitted.attach(test, 5, None, "p")) == 0
    one = learners.boosting_learner().fit(table, [configs[5]]).out_of_fold([0])
    assert differs(oof.filter("cfg = 5"), one) == 0


def test_encoder_is_searched_and_reported(spark, data):
    table, test = data
    pair = [two_level.Candidate("svm", learners.L1SvmLearner(), {"C": [0.1, 1.0]}, on_leaves=True)]
    grid = {"n_estimators": [2, 4], "max_depth": [2], "max_leaf_nodes": [3, 4], "learning_rate": [0.3]}
    level1, blend = two_level.run_stack(table, test, pair, tree_grid=grid, alphas=(0.1, 1.0))
    best = two_level.run_report(level1, blend)["level1"][two_level.ENCODER]
    assert best["metric"] == "f1" and best["best_parameter"] in search.expand_grid(grid)
    assert level1.columns == ("meta_svm",)
