"""Tree ensembles: estimators in the vocabulary of the searches, leaf codes, diagnostics."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How search parameters are called on the Spark estimators.
_NAMES = {
    "n_estimators": ("maxIter", int),
    "learning_rate": ("stepSize", float),
    "max_depth": ("maxDepth", int),
    "min_samples_leaf": ("minInstancesPerNode", int),
    "min_child_weight": ("minInstancesPerNode", int),
    "subsample": ("subsamplingRate", float),
    "max_bins": ("maxBins", int),
}


#: Accepted without effect: how the work is run, and the only loss there is.
_NEUTRAL = {"model_type", "loss", "objective", "silent", "n_jobs", "nthread", "random_state", "seed", "criterion"}
#: Applied to the fitted trees, see :mod:`tierblend.operators.nodes`.
_AFTER_FIT = {"max_leaf_nodes"}
_FEATURES = {"max_features", "colsample_bytree"}


def _settings(params: dict) -> dict:
    unknown = sorted(set(params) - set(_NAMES) - _NEUTRAL - _AFTER_FIT - _FEATURES)
    if unknown:
        raise ValueError(f"unknown tree parameters {unknown}")
    if str(params.get("loss", "deviance")) not in ("deviance", "log_loss") or params.get("objective", "binary:logistic") != "binary:logistic":
        raise ValueError("boosted trees minimise the logistic loss only")
    out = {spark: kind(params[name]) for name, (spark, kind) in _NAMES.items() if name in params}
    if "max_features" in params:  # a count of features per split
        out["featureSubsetStrategy"] = str(int(params["max_features"]))
    if "colsample_bytree" in params:  # a share of features per split
        out["featureSubsetStrategy"] = "all" if float(params["colsample_bytree"]) >= 1 else str(float(params["colsample_bytree"]))
    if params.get("max_leaf_nodes") is not None:
        if int(params["max_leaf_nodes"]) < 2:
            raise ValueError("max_leaf_nodes must be at least 2")
        if "max_depth" not in params:
            # a tree grown best first to m leaves may be m - 1 deep; deeper than this it is cut by depth first
            out["maxDepth"] = min(int(params["max_leaf_nodes"]) - 1, 8)
    return out


def boosted_trees(params: dict, features: str = "features", label: str = "label") -> GBTClassifier:
    """Gradient-boosted trees with row sampling (``subsample``) and feature sampling.

    ``max_leaf_nodes`` is not a setting of the fit: the fitted trees are cut back when they score.
    """
    est = GBTClassifier(
        featuresCol=features, labelCol=label, seed=int(params.get("random_state", params.get("seed", 0))),
        maxIter=100, stepSize=0.1, maxDepth=3, checkpointInterval=10, maxMemoryInMB=1024, leafCol="leaf",
    )
    return est.setParams(**_settings(params))


def random_forest(params: dict, features: str = "features", label: str = "label") -> RandomForestClassifier:
    settings = _settings({k: v for k, v in params.items() if k not in ("n_estimators", "learning_rate")})
    est = RandomForestClassifier(
        featuresCol=features, labelCol=label, seed=int(params.get("random_state", 0)),
        numTrees=int(params.get("n_estimators", 100)), impurity=params.get("criterion", "gini"),
        maxMemoryInMB=1024, leafCol="leaf",
    )
    return est.setParams(**settings)


def staged_loss(model, parts: dict[str, DataFrame]) -> DataFrame:
    """Loss after every boosting stage: ``(stage, part, loss)``, one pass per part."""
    rows = []
    for part, df in parts.items():
        rows += [(i, part, float(x)) for i, x in enumerate(model.evaluateEachIteration(df), start=1)]
    spark = next(iter(parts.values())).sparkSession
    return spark.createDataFrame(rows, "stage int, part string, loss double")


def feature_importances(model, df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(name, score)`` per feature of a tree ensemble, named from the vector metadata if possible."""
    vec = model.featureImportances
    if names is None:
        meta = df.schema[model.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        by_index = {a["idx"]: a.get("name", f"f{a['idx']}") for group in meta.values() for a in group}
        names = [by_index.get(i, f"f{i}") for i in range(vec.size)]
    rows = [(n, float(s)) for n, s in zip(names, vec.toArray())]
    return df.sparkSession.createDataFrame(rows, "name string, score double")


def rank_importances(table: DataFrame) -> DataFrame:
    return table.orderBy(F.col("score").desc(), F.col("name"))
