"""Repeatable splits. All parts of a table are told apart by comparing a row with constants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierblend.operators.ordering import hash_segment, numeric_order_statistics

# Fold seeds of the first and of the second level.
LEVEL1_SEED = 98754
LEVEL2_SEED = 325243


def random_split(df: DataFrame, key: str, test_size: float, seed: int = 0, name: str = "is_test") -> DataFrame:
    """Flag exactly ``ceil(test_size * n)`` rows as test rows."""
    marked = hash_segment(
        df, key, seed, lambda n: F.array(F.ceil(F.lit(float(test_size)) * n).cast("bigint")), name
    )
    if test_size <= 0:
        return marked.withColumn(name, F.lit(False))
    return marked.withColumn(name, F.col(name) == 0)


def stratified_folds(
    df: DataFrame, label: str, key: str, k: int = 5, seed: int = LEVEL1_SEED, name: str = "fold"
) -> DataFrame:
    """Add a fold number 0..k-1; the folds of every label value differ by at most one row."""

    def ends(n):
        base, extra = F.floor(n / F.lit(k)), n % F.lit(k)
        return F.array(*[(base * i + F.least(F.lit(i).cast("bigint"), extra)).cast("bigint") for i in range(1, k)])

    return hash_segment(df, key, seed, ends, name, by=label)


def three_way_holdout(df: DataFrame, key: str, ratio: float = 0.2, seed: int = 0, name: str = "part") -> DataFrame:
    """``train`` and, from the held-out share, ``ptrain`` (first model search) and ``ptest``."""
    first = random_split(df, key, ratio, seed, "_held")
    held = first.filter("_held").drop("_held")
    second = random_split(held, key, 0.5, seed + 1, "_late")
    rest = first.filter(~F.col("_held")).drop("_held").withColumn(name, F.lit("train"))
    parts = second.withColumn(name, F.when(F.col("_late"), "ptest").otherwise("ptrain")).drop("_late")
    return rest.unionByName(parts)


def sequential_split(df: DataFrame, key: str, ratio: float = 0.2, name: str = "part") -> DataFrame:
    """The same three parts taken in the order of a unique numeric key, without shuffling the rows."""

    def ends(n):
        held = F.floor(n * F.lit(float(ratio))).cast("bigint")
        half = F.floor(held * F.lit(0.5)).cast("bigint")
        return F.array(n - held, n - held + half)

    cuts = {r["ordinal"]: r["value"] for r in numeric_order_statistics(df, key, ends).collect()}
    part = F.lit("ptest")
    if 1 in cuts:
        part = F.when(F.col(key) <= F.lit(cuts[1]), "ptrain").otherwise(part)
    if 0 in cuts:
        part = F.when(F.col(key) <= F.lit(cuts[0]), "train").otherwise(part)
    return df.withColumn(name, part)


def complement(df: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``subset``."""
    return df.join(subset.select(key), key, "left_anti")
