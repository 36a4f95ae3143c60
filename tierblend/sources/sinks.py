"""Sinks. Each writes a folder of part files; nothing passes through the driver."""

from __future__ import annotations

import json

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierblend.functions.columns import exponent_text
from tierblend.operators.joins import submission
from tierblend.operators.ordering import with_row_number


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text with a header line; blanks at the ends of texts are kept."""
    kept = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**kept).csv(path)


def write_csv_with_id(df: DataFrame, path: str, order: str, name: str = "ID") -> None:
    """Number the rows 0, 1, ... in the order of a unique key and write them, number first."""
    write_csv(with_row_number(df, order, name), path)


def meta_feature_lines(df: DataFrame, score: str, label: str) -> DataFrame:
    """``score`` in exponent notation with ten decimals, ``label`` as an integer."""
    return df.select(exponent_text(score).alias(score), F.col(label).cast("int").alias(label))


def write_meta_feature(df: DataFrame, path: str, score: str, label: str) -> None:
    write_csv(meta_feature_lines(df, score, label), path)


def write_submission(ids: DataFrame, predictions: DataFrame, path: str, key: str, score: str) -> None:
    write_csv(submission(ids, predictions, key, score), path)


def write_weights(weights: DataFrame, path: str) -> None:
    """A blend-weight table (``intercept`` and one column per score) as delimited text; doubles keep every digit."""
    write_csv(weights.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in weights.columns]), path)


def report_frame(spark, report: dict) -> DataFrame:
    """A run report as one row of JSON with sorted keys."""
    text = json.dumps(report, sort_keys=True, ensure_ascii=False)
    return spark.createDataFrame([(text,)], "value string")


def write_report(spark, report: dict, path: str) -> None:
    report_frame(spark, report).write.text(path)


def save_model(model: Model, path: str) -> None:
    """Store a fitted model; single models are wrapped so that one loader serves all."""
    wrapped = model if isinstance(model, PipelineModel) else PipelineModel([model])
    wrapped.write().overwrite().save(path)
