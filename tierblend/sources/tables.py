"""Scans of delimited files and stored results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the census table and the categorical ones among them.
CENSUS_COLUMNS = (
    ("age", "int"), ("workclass", "string"), ("fnlwgt", "int"), ("education", "string"),
    ("education-num", "int"), ("marital-status", "string"), ("occupation", "string"),
    ("relationship", "string"), ("race", "string"), ("sex", "string"), ("capital-gain", "int"),
    ("capital-loss", "int"), ("hours-per-week", "int"), ("native-country", "string"), ("TARGET", "string"),
)
CENSUS_CATEGORICALS = (
    "workclass", "education", "marital-status", "occupation", "relationship", "race", "sex", "native-country",
)
CENSUS_LOGGED = ("fnlwgt", "capital-gain", "capital-loss")
CENSUS_POSITIVE = ">50K"


def census_schema() -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType() if k == "int" else T.StringType()) for n, k in CENSUS_COLUMNS])


def scan_named(spark: SparkSession, path: str, schema: T.StructType | str, trim_numbers: bool = False) -> DataFrame:
    """Delimited file with given names; its header line is skipped, text keeps its blanks.

    ``trim_numbers`` drops blanks around numbers (files separated by comma and blank).
    """
    reader = spark.read.option("header", True).option("enforceSchema", True)
    if not trim_numbers:
        return reader.schema(schema).csv(path)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    text = reader.schema(raw).csv(path)
    return text.select(*[
        F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def scan_float(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Delimited file in which every column is single precision."""
    return scan_named(spark, path, T.StructType([T.StructField(c, T.FloatType()) for c in columns]))


def scan_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def scan_matching(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """All files of a name pattern, with the name of the file each row came from."""
    df = spark.read.option("header", True).schema(schema).csv(pattern)
    return df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def scan_weights(spark: SparkSession, path: str) -> DataFrame:
    """A stored blend-weight table; every column is a double."""
    text = spark.read.option("header", True).csv(path)
    return text.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in text.columns])


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
