"""Removal of columns that carry no information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FRACTION = ("double", "float")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with a single value, by one aggregate of extremes."""
    row = df.agg(*[(F.min(c) == F.max(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[str(i)]]


def drop_constants(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    gone = constant_columns(df, columns)
    return df.drop(*gone), gone


def _missing(df: DataFrame, c: str) -> Column:
    gap = F.col(c).isNull()
    return gap | F.isnan(c) if df.schema[c].dataType.typeName() in _FRACTION else gap


def identical_columns(df: DataFrame, columns: Sequence[str], key: str) -> list[str]:
    """Columns equal, row by row, to an earlier one. A column with a missing value never is.

    First one aggregate takes a fingerprint of every column. Columns sharing a fingerprint are then
    compared value by value with the first of them only; should some differ in spite of the
    fingerprint they form a group of their own and are compared again.
    """
    text = {"string", "binary"}

    def print_of(c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        value = F.col(c) if kind in text else F.col(c).cast("double") + F.lit(0.0)
        return F.bit_xor(F.xxhash64(F.col(key), value))

    row = df.agg(
        *[print_of(c).alias(f"h{i}") for i, c in enumerate(columns)],
        *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(columns):
        if row[f"m{i}"] == 0:
            family = "text" if df.schema[c].dataType.typeName() in text else "number"
            groups.setdefault((family, row[f"h{i}"]), []).append(c)
    open_groups = [g for g in groups.values() if len(g) > 1]
    gone: set[str] = set()
    while open_groups:
        pairs = [(g[0], c) for g in open_groups for c in g[1:]]
        diff = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
        differs = {b for i, (_, b) in enumerate(pairs) if diff[str(i)] > 0}
        gone |= {b for _, b in pairs if b not in differs}
        open_groups = [left for g in open_groups if len(left := [c for c in g[1:] if c in differs]) > 1]
    return [c for c in columns if c in gone]


def drop_identicals(df: DataFrame, columns: Sequence[str], key: str) -> tuple[DataFrame, list[str]]:
    gone = identical_columns(df, columns, key)
    return df.drop(*gone), gone


def top_features(df: DataFrame, importances: Sequence[float], n: int, vector: str = "features", output: str = "top") -> DataFrame:
    """Keep the ``n`` vector positions of highest importance, highest first."""
    order = sorted(range(len(importances)), key=lambda i: (-importances[i], i))[:n]
    return VectorSlicer(inputCol=vector, outputCol=output, indices=order).transform(df)
