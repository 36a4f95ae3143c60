"""The library's own models as stages of a Spark ML pipeline, stored and loaded with it.

Every estimator wraps a fit of :mod:`tierblend.operators`; its model keeps the fitted numbers in ``fitted`` and stores
them as rows beside its settings, so a dictionary or a weight vector of any width is written by Spark. Nulls are
treated as by the wrapped model; columns that a stage does not name pass through.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierblend.operators import encode, margins, nodes, ridge, scale, trees


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, kind)


class _HasColumns(Params):
    columns = _param("columns", "input columns, in order", TypeConverters.toListString)


class _HasLabel(Params):
    label = _param("label", "column of classes 0 and 1", TypeConverters.toString)


class _HasFeatures(Params):
    features = _param("features", "vector column", TypeConverters.toString)


class _HasOutput(Params):
    output = _param("output", "column to be added", TypeConverters.toString)


class _Fit(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator whose settings are given by name."""

    defaults: dict = {}
    result: type

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(**self.defaults)
        self._set(**settings)

    def _value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def _fit(self, dataset: DataFrame):
        model = self.result()
        model.fitted = self._fitted(dataset)
        return self._copyValues(model)


class _Writer(MLWriter):
    def __init__(self, model: _Fitted):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model._write(self.sparkSession, path)


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.fitted = model._read(self.sparkSession, path)
        return model


class _Fitted(Model, MLWritable, MLReadable):
    """A model whose numbers are rows of one table; ``_rows`` and ``_restored`` convert them."""

    fitted = None
    fields = ""

    def _value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)

    def _write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self._rows(), self.fields).write.parquet(f"{path}/data")

    def _read(self, spark: SparkSession, path: str):
        return self._restored(spark.read.schema(self.fields).parquet(f"{path}/data").collect())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)


class ColumnScalerModel(_Fitted, _HasColumns):
    fields = "name string, shift double, scale double"

    def _rows(self):
        return [(c, self.fitted.shift[c], self.fitted.scale[c]) for c in self._value("columns")]

    def _restored(self, rows):
        return scale.AffineModel({r["name"]: r["shift"] for r in rows}, {r["name"]: r["scale"] for r in rows})


class ColumnScaler(_Fit, _HasColumns):
    """Scale ``columns`` by ``kind``: minmax, standard or unit_norm."""

    kind = _param("kind", "minmax, standard or unit_norm", TypeConverters.toString)
    defaults = {"kind": "minmax"}
    result = ColumnScalerModel

    def _fitted(self, df):
        fits = {"minmax": scale.fit_minmax, "standard": scale.fit_standard, "unit_norm": scale.fit_unit_norm}
        return fits[self._value("kind")](df, self._value("columns"))


class OneHotColumnsModel(_Fitted, _HasColumns, _HasOutput):
    fields = "name string, column string, value string"

    def _rows(self):
        return [(n, c, v) for n, (c, v) in zip(self.fitted.names, self.fitted.pairs)]

    def _restored(self, rows):
        # the names were fitted in sorted order
        found = sorted((r["name"], (r["column"], r["value"])) for r in rows)
        return encode.OneHotModel(tuple(self._value("columns")), tuple(n for n, _ in found), tuple(p for _, p in found))

    def _transform(self, df):
        return self.fitted.transform_sparse(df, self._value("output"))


class OneHotColumns(_Fit, _HasColumns, _HasOutput):
    """Replace categorical ``columns`` by one sparse 0/1 vector."""

    defaults = {"output": "onehot"}
    result = OneHotColumnsModel

    def _fitted(self, df):
        return encode.fit_one_hot([df], self._value("columns"))


class FirstSeenCodesModel(_Fitted, _HasColumns):
    def _write(self, spark, path):
        for i, c in enumerate(self._value("columns")):
            self.fitted.dictionaries[c].write.parquet(f"{path}/data/{i}")

    def _read(self, spark, path):
        return encode.FactorizeModel({c: spark.read.parquet(f"{path}/data/{i}") for i, c in enumerate(self._value("columns"))})


class FirstSeenCodes(_Fit, _HasColumns):
    """Replace the values of ``columns`` by 0, 1, ... in the sequence of the column ``order``."""

    order = _param("order", "column that orders the rows", TypeConverters.toString)
    result = FirstSeenCodesModel

    def _fitted(self, df):
        return encode.fit_factorize(df, self._value("columns"), self._value("order"))


class ComponentsModel(_Fitted, _HasColumns):
    """The first row holds the means, the others one component each."""

    fields = "component int, explained double, loadings array<double>"

    def _rows(self):
        parts = zip(self.fitted.explained, self.fitted.components)
        return [(0, None, list(self.fitted.mean))] + [(j, e, list(w)) for j, (e, w) in enumerate(parts, 1)]

    def _restored(self, rows):
        mean, *parts = sorted(rows, key=lambda r: r["component"])
        return scale.PcaModel(tuple(self._value("columns")), tuple(mean["loadings"]),
                              tuple(tuple(r["loadings"]) for r in parts), tuple(r["explained"] for r in parts))


class Components(_Fit, _HasColumns):
    """Replace ``columns`` by their first ``k`` principal components."""

    k = _param("k", "number of components", TypeConverters.toInt)
    result = ComponentsModel

    def _fitted(self, df):
        return scale.fit_pca(df, self._value("columns"), self._value("k"))


class RidgeBlendModel(_Fitted, _HasColumns, _HasLabel):
    alpha = _param("alpha", "strength of the penalty", TypeConverters.toFloat)
    fields = "position int, name string, weight double"

    def _rows(self):
        return [(0, "intercept", self.fitted.intercept)] + [
            (i, c, w) for i, (c, w) in enumerate(zip(self.fitted.columns, self.fitted.weights), 1)]

    def _restored(self, rows):
        first, *rest = sorted(rows, key=lambda r: r["position"])
        return ridge.RidgeModel(tuple(r["name"] for r in rest), first["weight"], tuple(r["weight"] for r in rest),
                                {"alpha": self._value("alpha")})


class RidgeBlend(_Fit, _HasColumns, _HasLabel):
    """Ridge classifier over score columns."""

    alpha = _param("alpha", "strength of the penalty", TypeConverters.toFloat)
    defaults = {"alpha": 1.0, "label": "label"}
    result = RidgeBlendModel

    def _fitted(self, df):
        return ridge.fit_ridge(df, self._value("columns"), self._value("label"), self._value("alpha"))


class SparseMarginModel(_Fitted, _HasFeatures, _HasLabel):
    """Weights other than 0; position -1 is the intercept, and the row of null weight holds the width."""

    fields = "position int, weight double"

    def _rows(self):
        w = self.fitted.weights
        return [(len(w), None), (-1, self.fitted.intercept)] + [(int(i), float(w[i])) for i in np.flatnonzero(w)]

    def _restored(self, rows):
        width = next(r["position"] for r in rows if r["weight"] is None)
        weights, intercept = np.zeros(width), 0.0
        for position, weight in rows:
            if position == -1:
                intercept = weight
            elif weight is not None:
                weights[position] = weight
        return margins.LinearMargin(weights, intercept, self._value("features"))


class SparseMargin(_Fit, _HasFeatures, _HasLabel):
    """Squared-hinge machine with L1 penalty."""

    strength = _param("strength", "weight of the loss against the penalty", TypeConverters.toFloat)
    defaults = {"features": "features", "label": "label", "strength": 1.0}
    result = SparseMarginModel

    def _fitted(self, df):
        c = self._value("strength")
        return margins.fit_l1_svm(df, [c], self._value("features"), self._value("label"))[(c, None)]


class TreeCodesModel(_Fitted, _HasFeatures, _HasOutput):
    """``fitted`` is the Spark tree model; the codes follow from its node table."""

    cap = _param("cap", "most leaves per tree, 0 for all", TypeConverters.toInt)

    def _write(self, spark, path):
        self.fitted.write().save(f"{path}/trees")

    def _read(self, spark, path):
        return DefaultParamsReader.loadParamsInstance(f"{path}/trees", spark)

    def _transform(self, df):
        held = "_leaf_numbers"
        while held in df.columns:
            held = f"_{held}"
        codes = encode.LeafCodes(nodes.ensemble(self.fitted, df.sparkSession), self._value("cap") or None)
        return codes.transform(nodes.with_leaves(self.fitted, df, held), held, self._value("output")).drop(held)


class TreeCodes(_Fit, _HasFeatures, _HasLabel, _HasOutput):
    """One-hot codes of the leaves of boosted trees; ``params`` is a JSON object in the terms of the searches."""

    cap = _param("cap", "most leaves per tree, 0 for all", TypeConverters.toInt)
    params_json = _param("params_json", "settings of the trees as JSON", TypeConverters.toString)
    defaults = {"features": "features", "label": "label", "output": "leaf_codes", "cap": 0, "params_json": "{}"}
    result = TreeCodesModel

    def _fitted(self, df):
        features, label = self._value("features"), self._value("label")
        est = trees.boosted_trees(json.loads(self._value("params_json")), features, label)
        return est.fit(df.select(F.col(label).cast("double").alias(label), features))
