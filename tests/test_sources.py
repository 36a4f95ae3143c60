from pyspark.sql import functions as F

from tierblend.functions.columns import binary_label
from tierblend.session import scratch_path, work_dir
from tierblend.sources import sinks, tables

CENSUS = """a,b
39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K
50, Private, 83311, HS-grad, 9, Divorced, Sales, Husband, White, Male, 0, 0, 13, United-States, >50K
"""


def test_census_scan_skips_the_header_and_keeps_blanks(spark, tmp_path):
    (tmp_path / "c.csv").write_text(CENSUS)
    df = tables.scan_named(spark, str(tmp_path / "c.csv"), tables.census_schema(), trim_numbers=True)
    rows = df.orderBy("age").collect()
    assert [r["age"] for r in rows] == [39, 50] and [r["fnlwgt"] for r in rows] == [77516, 83311]
    assert rows[0]["workclass"] == " State-gov"
    assert [r["y"] for r in df.orderBy("age").select(binary_label("TARGET", tables.CENSUS_POSITIVE).alias("y")).collect()] == [0, 1]


def test_inferred_scan(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ID,p,s\n1,0.5,a\n2,1.5,b\n")
    assert dict(tables.scan_inferred(spark, str(tmp_path / "x.csv")).dtypes) == {"ID": "int", "p": "double", "s": "string"}


def test_matching_files(spark, tmp_path):
    for m in ("LR-L1", "LR-L2"):
        (tmp_path / f"meta_leaf_train_{m}.csv").write_text("p,label\n0.25,1\n")
    (tmp_path / "meta_rf_train.csv").write_text("p,label\n0.75,0\n")
    got = tables.scan_matching(spark, str(tmp_path / "meta_leaf*train*.csv"), "p double, label int")
    assert sorted(r["file"] for r in got.collect()) == ["meta_leaf_train_LR-L1.csv", "meta_leaf_train_LR-L2.csv"]


def test_meta_feature_text(spark, tmp_path):
    df = spark.createDataFrame([(0.123456789, 1.0), (0.0, 0.0)], "meta_rf double, label double")
    path = str(tmp_path / "meta")
    sinks.write_meta_feature(df, path, "meta_rf", "label")
    lines = sorted(r[0] for r in spark.read.text(path).filter(~F.col("value").startswith("meta")).collect())
    assert lines == ["0.0000000000e+00,0", "1.2345678900e-01,1"]


def test_working_folder_is_the_named_one(spark):
    assert scratch_path(spark, "x").startswith(work_dir(spark) + "/x-")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_report_is_written_as_json(spark, tmp_path):
    sinks.write_report(spark, {"b": 1, "a": {"d": [1, 2], "c": "x"}}, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"a": {"c": "x", "d": [1, 2]}, "b": 1}'
