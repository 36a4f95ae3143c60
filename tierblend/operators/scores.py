"""Class-1 scores in [0, 1] from fitted Spark ML models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minmax_calibrate(df: DataFrame, raw: str, output: str = "p", batch: Sequence[str] = ()) -> DataFrame:
    """Min-max of a decision value over each scored batch; a constant batch becomes 0.

    The extremes are one row per batch. They are attached as a constant (one batch) or looked up.
    """
    batch = list(batch)
    ends = df.groupBy(*batch).agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span > 0, (F.col(raw) - F.col("_lo")) / span).otherwise(F.lit(0.0))
    if not batch:
        both = ends.select(F.struct("_lo", "_hi")).scalar()
        work = df.withColumn("_e", both).withColumn("_lo", F.col("_e._lo")).withColumn("_hi", F.col("_e._hi"))
        return work.withColumn(output, value).drop("_e", "_lo", "_hi")
    return df.join(ends, batch).withColumn(output, value).drop("_lo", "_hi")


def class1_score(scored: DataFrame, output: str = "p", calibration: str = "auto", batch: Sequence[str] = ()) -> DataFrame:
    """The class-1 probability of a transformed table, or the min-max of its decision value."""
    if calibration == "auto":
        calibration = "probability" if "probability" in scored.columns else "minmax"
    if calibration == "probability":
        return scored.withColumn(output, vector_to_array("probability")[1])
    raw = scored.schema["rawPrediction"].dataType.typeName()
    value = F.col("rawPrediction") if raw == "double" else vector_to_array("rawPrediction")[1]
    return minmax_calibrate(scored.withColumn("_raw", value), "_raw", output, batch).drop("_raw")
