import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tierblend.catalog.fixtures import basket_vectors, doc_features, meta_wide
from tierblend.operators import ridge
from tierblend.plans import search
from tierblend.plans.learners import SparkLearner, fold_table, logistic_learner
from tierblend.plans.store import ResultStore, entry_name, table_digest
from tierblend.sources import sinks, stages, tables


def _again(stage, df, path):
    """Rows before and after storing; the stored pipeline must also be a pipeline of the same settings."""
    fitted = Pipeline(stages=stage if isinstance(stage, list) else [stage]).fit(df)
    sinks.save_model(fitted, path)
    loaded = tables.load_model(path)
    assert isinstance(loaded, PipelineModel)
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
    a, b = fitted.transform(df), loaded.transform(df)
    assert a.columns == b.columns
    return a, b


def _same(a, b):
    key = lambda r: str(r)
    rows = sorted(map(tuple, a.collect()), key=key)
    assert rows == sorted(map(tuple, b.collect()), key=key)
    return rows


def test_pipeline_of_column_stages(spark, sf, tmp_path):
    df = doc_features(spark, sf)
    steps = [
        stages.FirstSeenCodes(columns=["lang"], order="ID"),
        stages.OneHotColumns(columns=["source"]),
        stages.ColumnScaler(columns=["n_chars", "n_words"], kind="standard"),
        stages.Components(columns=["n_chars", "n_words", "uniq_ratio"], k=2),
        stages.RidgeBlend(columns=["pc1", "pc2", "alpha_ratio"], label="TARGET", alpha=0.5),
    ]
    rows = _same(*_again(steps, df, str(tmp_path / "p")))
    assert len(rows) == df.count()


@pytest.mark.parametrize("kind", ["minmax", "unit_norm"])
def test_scalers_keep_unnamed_columns(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y"), (3, 6.0, None)], "ID int, `a,b` double, shift string")
    rows = _same(*_again(stages.ColumnScaler(columns=["a,b"], kind=kind), df, str(tmp_path / "s")))
    assert [r[2] for r in sorted(rows)] == ["x", "y", None] and sorted(rows)[1][1] is None


def test_vector_stages(spark, sf, tmp_path):
    df = basket_vectors(spark, sf).withColumn("_leaf_numbers", F.lit("mine"))
    steps = [stages.TreeCodes(cap=3, params_json='{"n_estimators": 3, "max_depth": 2}', output="codes"),
             stages.SparseMargin(features="codes", strength=0.1)]
    rows = _same(*_again(steps, df, str(tmp_path / "t")))
    assert {r[3] for r in rows} == {"mine"}


def test_weight_file_keeps_every_digit(spark, sf, tmp_path):
    model = ridge.fit_ridge(meta_wide(spark, sf), ["meta_a", "meta_b"], "label", 0.1)
    odd = ridge.RidgeModel(("a,b", 'c"d'), 1 / 3, (1e-300, -2.0 / 7))
    for i, m in enumerate((model, odd)):
        sinks.write_weights(m.weight_table(spark), str(tmp_path / str(i)))
        again = tables.scan_weights(spark, str(tmp_path / str(i)))
        assert again.columns == ["intercept", *m.columns] and tuple(again.first()) == (m.intercept, *m.weights)


class _Counting(SparkLearner):
    fitted = []

    def fit(self, table, configs, folds=True, whole=False):
        self.fitted.extend(c["C"] for c in configs)
        return super().fit(table, configs, folds, whole)


def test_second_search_fits_only_what_is_new(spark, sf, tmp_path):
    table = fold_table(basket_vectors(spark, sf).limit(300), 2)
    base = logistic_learner("l2")
    learner = _Counting(base.build, base.calibration)
    store = ResultStore(str(tmp_path / "store"), "lr-l2")
    first = search.grid_search(learner, table, {"C": [0.01, 1.0]}, store=store)
    assert learner.fitted == [0.01, 1.0]
    again = search.run_search(learner, table, [{"C": 1.0}, {"C": 10.0}, {"C": 0.01}, {"C": 1.0}], store=store)
    assert learner.fitted == [0.01, 1.0, 10.0]
    assert again.rounds[0].count() == 4 * table.df.count()
    of = lambda found, cfg: sorted(str(r["score"]) for r in found.scores.filter(F.col("cfg") == cfg).collect())
    assert of(first, 1) == of(again, 0) == of(again, 3) and of(first, 0) == of(again, 2)
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_writing")]
    # other rows are other entries
    other = fold_table(basket_vectors(spark, sf).limit(299), 2)
    search.grid_search(learner, other, {"C": [1.0]}, store=store)
    assert learner.fitted == [0.01, 1.0, 10.0, 1.0]


def test_digests(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert table_digest(df) == table_digest(df.orderBy(F.desc("k")).select("v", "k"))
    others = [df.distinct(), df.withColumnRenamed("v", "w"), df.fillna(""), spark.createDataFrame([(1, None), (2, "a"), (2, "a")], df.schema)]
    assert len({table_digest(x) for x in [df, *others]}) == 5
    assert entry_name("m", "t", {"a": 1, "b": 2}) == entry_name("m", "t", {"b": 2, "a": 1}) != entry_name("m", "t", {"a": 1.0, "b": 2})
