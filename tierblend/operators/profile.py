"""Column summaries, distributions and threshold filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierblend.operators.ordering import exact_quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            F.struct(
                F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"), F.max(x).alias("max"),
            ).alias(c)
        ]
    quartiles = {c: exact_quantiles(df, c, [0.25, 0.5, 0.75]) for c in columns}

    def entry(c):
        q = [F.lit(v).cast("double") for v in quartiles[c]]
        return F.struct(
            F.lit(c).alias("column"), F.col(f"`{c}`.n").alias("n"), F.col(f"`{c}`.mean").alias("mean"),
            F.col(f"`{c}`.std").alias("std"), F.col(f"`{c}`.min").alias("min"), q[0].alias("p25"),
            q[1].alias("p50"), q[2].alias("p75"), F.col(f"`{c}`.max").alias("max"),
        )

    return df.agg(*aggs).select(F.explode(F.array(*[entry(c) for c in columns])).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram with density: ``(bin, left, right, n, density)`` for every bin.

    The last bin includes its right edge; a constant column is given the width 1 around its value.
    """
    spark = df.sparkSession
    x = F.col(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return spark.range(bins).select(
            F.col("id").cast("int").alias("bin"), F.lit(None).cast("double").alias("left"),
            F.lit(None).cast("double").alias("right"), F.lit(0).cast("bigint").alias("n"),
            F.lit(None).cast("double").alias("density"),
        )
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    # the counts have at most one row per bin
    counts = df.filter(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = frame.join(F.broadcast(counts), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return filled.select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("right"),
        "n",
        (F.col("n") / total / F.lit(width)).alias("density"),
    )


def cumulative(hist: DataFrame) -> DataFrame:
    """Running share of a histogram, at most one row per bin."""
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    run = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return hist.select("bin", "right", F.when(total > 0, run / total).alias("cdf"))


def keep_upper_scores(df: DataFrame, score: str, prob: float = 0.8, min_rows: int = 20) -> DataFrame:
    """With more than ``min_rows`` rows keep those at or above a quantile of the positive scores."""
    if df.limit(min_rows + 1).count() <= min_rows:
        return df
    cut = exact_quantiles(df.filter(F.col(score) > 0), score, [prob])[0]
    return df.filter(F.col(score) >= F.lit(cut).cast("double"))
