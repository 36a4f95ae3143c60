"""Queries around fitted models. Short tree ensembles that SQL can fit as well are in ``tree_queries``."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierblend.catalog.fixtures import BASKET_COLUMNS, basket_split, meta_wide
from tierblend.catalog.registry import query
from tierblend.operators import encode, margins, metrics, nodes, profile, select, splits, trees
from tierblend.operators.scores import class1_score
from tierblend.plans import learners, search, two_level
from tierblend.session import scratch_path
from tierblend.sources import sinks

TREES = {"n_estimators": 10, "max_depth": 4, "max_leaf_nodes": 10, "learning_rate": 0.1, "subsample": 0.9, "max_features": 5,
         "min_samples_leaf": 8}
# The published penalties and numbers of neighbours, the seed, and members of the published tree grids.
STRENGTHS = [0.01, 0.1, 1.0, 10.0, 100.0]
STRENGTH_PAIR = [0.1, 10.0]
NEIGHBOURS = [1, 2, 4, 8, 16, 24, 32, 64]
BOOSTING_SEED = 9438
TREE_GRID = {"n_estimators": [10], "max_depth": [2, 4], "max_leaf_nodes": [5, 10], "learning_rate": [0.1], "subsample": [0.9],
             "max_features": [5], "min_samples_leaf": [8], "random_state": [0]}
FOREST_GRID = {"max_depth": [2, 4, 8], "max_leaf_nodes": [5, 7, 9], "criterion": ["entropy", "gini"], "n_estimators": [50],
               "min_samples_leaf": [3]}
XGB_GRID = {"max_depth": [2, 4], "n_estimators": [50], "min_child_weight": [3], "subsample": [0.9], "colsample_bytree": [0.9],
            "learning_rate": [0.1], "seed": [BOOSTING_SEED]}


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def _fit_and_score(spark: SparkSession, d: str, estimator, calibration: str = "auto") -> DataFrame:
    """Fit on the training table, score the test table: ``(ID, label, p)``."""
    train, test = basket_split(spark, d)
    model = estimator(sum(n for _, n in train.counts)).fit(train.df.select("label", "features"))
    return class1_score(model.transform(test), "p", calibration).select("ID", "label", "p")


# ---- tree ensembles and their codes ----


@query()
def gbt_scores(spark, d):
    return _fit_and_score(spark, d, lambda n: trees.boosted_trees(TREES))


@query()
def gbt_sampled_scores(spark, d):
    settings = {"n_estimators": 8, "max_depth": 4, "learning_rate": 0.3, "subsample": 0.5, "colsample_bytree": 0.5,
                "min_child_weight": 3, "seed": BOOSTING_SEED}
    return _fit_and_score(spark, d, lambda n: trees.boosted_trees(settings))


@query()
def rf_scores(spark, d):
    settings = {"n_estimators": 20, "max_depth": 8, "min_samples_leaf": 3, "criterion": "entropy"}
    return _fit_and_score(spark, d, lambda n: trees.random_forest(settings))


def _leaf_model(spark, d):
    train, test = basket_split(spark, d)
    return train, test, trees.boosted_trees(TREES).fit(train.df.select("label", "features"))


@query()
def gbt_leaf_ids(spark, d):
    _, test, model = _leaf_model(spark, d)
    return model.transform(test).select("ID", vector_to_array("leaf").cast("array<int>").alias("leaf"))


@query()
def leaf_one_hot(spark, d):
    """Codes per row as (size, number of ones)."""
    _, test, model = _leaf_model(spark, d)
    hot = encode.LeafCodes(nodes.ensemble(model, spark), TREES["max_leaf_nodes"])
    coded = F.unwrap_udt("leaf_onehot")
    return hot.transform(nodes.with_leaves(model, test)).select(
        "ID", coded["size"].alias("n_codes"), F.size(coded["indices"]).alias("n_active")
    )


@query()
def top_importance_slice(spark, d):
    train, test, model = _leaf_model(spark, d)
    top = select.top_features(test, list(model.featureImportances.toArray()), 2)
    return top.select("ID", vector_to_array("top").alias("top"))


@query()
def importance_ranking(spark, d):
    train, _, model = _leaf_model(spark, d)
    table = trees.feature_importances(model, train.df, list(BASKET_COLUMNS))
    return trees.rank_importances(profile.keep_upper_scores(table, "score")).select("name", r6("score"))


@query()
def staged_loss(spark, d):
    train, test, model = _leaf_model(spark, d)
    return trees.staged_loss(model, {"train": train.df, "test": test}).select("stage", "part", r6("loss"))


# ---- linear models ----


@query()
def logreg_l2_scores(spark, d):
    return _fit_and_score(spark, d, lambda n: margins.logistic(1.0, "l2", n))


@query()
def logreg_l1_scores(spark, d):
    return _fit_and_score(spark, d, lambda n: margins.logistic(1.0, "l1", n))


@query()
def svc_l2_scores(spark, d):
    return _fit_and_score(spark, d, lambda n: margins.hinge_svm(1.0, n), "minmax")


@query()
def svc_l1_scores(spark, d):
    train, test = basket_split(spark, d)
    model = margins.fit_l1_svm(train.df, [1.0])[(1.0, None)]
    return class1_score(model.transform(test), "p", "minmax").select("ID", "label", "p")


# ---- searches ----


@query()
def cv_scores(spark, d):
    train, _ = basket_split(spark, d)
    found = search.run_search(learners.logistic_learner("l2"), train, [{"C": 1.0}])
    return found.scores.select("cfg", "fold", "metric", r6("score"))


@query()
def grid_search_results(spark, d):
    """Forest settings, selected by AUC; the caps on leaves share their fits."""
    train, _ = basket_split(spark, d)
    return search.described(search.grid_search(learners.forest_learner(), train, FOREST_GRID | {"max_depth": [2, 8]}))


@query()
def grid_search_f1(spark, d):
    """L1 squared-hinge machine, selected by F1 of class 1."""
    train, _ = basket_split(spark, d)
    return search.described(search.grid_search(learners.L1SvmLearner(), train, {"C": STRENGTHS}, "f1"))


@query()
def refit_predictions(spark, d):
    train, test = basket_split(spark, d)
    configs = search.expand_grid({"C": [0.01, 1.0]})
    return search.refit_predictions(learners.logistic_learner("l2"), train, test, configs)


@query()
def sampled_search(spark, d):
    """All 201 drawn boosting settings, ranked by the pessimistic loss."""
    train, _ = basket_split(spark, d)
    space = {"max_depth": ("quniform", 2, 5, 1), "min_child_weight": ("quniform", 3, 7, 1), "subsample": ("uniform", 0.5, 1.0),
             "colsample_bytree": ("uniform", 0.5, 1.0), "learning_rate": ("uniform", 0.1, 0.3), "n_estimators": 5, "seed": BOOSTING_SEED}
    found = search.sampled_search(learners.boosting_learner(), train, space)
    best = search.top_configs(found.scores, "auc", use_lower=True)
    return best.join(search.grid_table(spark, found.configs), "cfg").select("cfg", "params", r6("loss"))


# ---- two-level models ----


@query()
def oof_meta_features(spark, d):
    train, test = basket_split(spark, d)
    learner = learners.logistic_learner("l2")
    meta, _ = two_level.out_of_fold_meta(learner, train, {"C": 1.0}, test, "meta_lr")
    return meta


def _linear_candidates() -> list[two_level.Candidate]:
    return [
        two_level.Candidate("leaf_lr_l2", learners.logistic_learner("l2"), {"C": STRENGTHS}, on_leaves=True),
        two_level.Candidate("leaf_lr_l1", learners.logistic_learner("l1"), {"C": STRENGTHS}, on_leaves=True),
        two_level.Candidate("leaf_svm_l2", learners.hinge_svm_learner(), {"C": STRENGTHS}, on_leaves=True),
        two_level.Candidate("leaf_svm_l1", learners.L1SvmLearner(), {"C": STRENGTHS}, on_leaves=True),
    ]


def _model_rows(level1: two_level.Level1) -> DataFrame:
    """Test scores of every level-1 model, one aggregate over the stacked meta columns."""
    long = level1.meta_test.unpivot(["ID", "label"], list(level1.columns), "model", "p")
    return metrics.evaluate(long, "label", "p", ["model"])


@query()
def trees_plus_linear(spark, d):
    train, test = basket_split(spark, d)
    level1 = two_level.fit_level1(train, test, _linear_candidates(), tree_grid=TREE_GRID)
    out = _model_rows(level1)
    return out.select("model", "rows", *[r6(c) for c in metrics.SCORE_NAMES])


@query()
def blend_evaluation(spark, d):
    """Ridge blend of two text measures; a fifth of the documents is the test table."""
    marked = splits.random_split(meta_wide(spark, d), "ID", 0.2)
    train, test = marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")
    blend = two_level.fit_blend(train, test, ("meta_a", "meta_b"), hold_out=0.5, k=5)
    return blend.evaluation.select("tn", "fp", "fn", "tp", *[r6(c) for c in blend.evaluation.columns[4:]])


def flagship_candidates() -> list[two_level.Candidate]:
    return [
        two_level.Candidate("knn", learners.KnnLearner(), {"n_neighbors": NEIGHBOURS, "weights": ["distance"]}),
        two_level.Candidate("rf", learners.forest_learner(), FOREST_GRID | {"max_depth": [8], "criterion": ["entropy"]}),
        two_level.Candidate("xgb", learners.boosting_learner(), XGB_GRID | {"max_depth": [4]}),
        *_linear_candidates(),
    ]


def _stack(spark, d):
    train, test = basket_split(spark, d)
    return two_level.run_stack(train, test, flagship_candidates(), tree_grid=TREE_GRID)


@query()
def stacked_ensemble(spark, d):
    """The whole flow: a row per level-1 model and one for the blend, scored on the test table."""
    level1, blend = _stack(spark, d)
    names = ["accuracy", "precision", "recall", "f1"]
    models = _model_rows(level1).select("model", *names)
    total = blend.evaluation.select(F.lit("ridge_blend").alias("model"), *names)
    weights = dict(zip(blend.model.columns, blend.model.weights)) | {"ridge_blend": blend.model.intercept}
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("model"))
    return models.unionByName(total).select("model", weight.alias("weight"), *[r6(c) for c in names])


@query()
def run_report_json(spark, d):
    """Report of a run, written and read back as JSON."""
    train, test = basket_split(spark, d)
    pair = [two_level.Candidate("lr", learners.logistic_learner("l2"), {"C": STRENGTH_PAIR}),
            two_level.Candidate("svm", learners.L1SvmLearner(), {"C": STRENGTHS}, on_leaves=True)]
    level1, blend = two_level.run_stack(train, test, pair, tree_grid=TREE_GRID)
    path = scratch_path(spark, "report")
    sinks.write_report(spark, two_level.run_report(level1, blend), path)
    return spark.read.text(path)
