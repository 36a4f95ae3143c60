"""Classification metrics as aggregates, optionally per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierblend.functions.columns import LOG_LOSS_EPS, as_col, ratio
from tierblend.operators.ordering import range_splits, with_range


def hinge_loss(label: Column | str, score: Column | str) -> Column:
    """Mean ``max(0, 1 - y*s)`` with y = -1/+1 and the score as it is."""
    y = F.when(as_col(label) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    return F.avg(F.greatest(F.lit(0.0), F.lit(1.0) - y * as_col(score)))


def log_loss(label: Column | str, score: Column | str) -> Column:
    """Mean negative log likelihood of clipped probabilities."""
    p = F.least(F.greatest(as_col(score), F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    y = as_col(label).cast("double")
    return -F.avg(y * F.ln(p) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - p))


def mean_squared_error(label: Column | str, score: Column | str) -> Column:
    d = as_col(label).cast("double") - as_col(score)
    return F.avg(d * d)


def confusion_counts(label: Column | str, predicted: Column | str) -> list[Column]:
    y, p = as_col(label) == 1, as_col(predicted) == 1
    return [
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
    ]


def confusion_matrix(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_counts(label, predicted))


def report_columns() -> list[Column]:
    """Scores of class 1, and the class-0 variant in which precision and recall change places."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return [
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tn, tn + fp).alias("precision_class0_swapped"),
        ratio(tn, tn + fn).alias("recall_class0_swapped"),
        ratio(2 * tn, 2 * tn + fp + fn).alias("f_class0_swapped"),
    ]


def classification_report(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    return confusion_matrix(df, label, predicted, by).select(*by, "tn", "fp", "fn", "tp", *report_columns())


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve; tied scores count one half; null with a single class.

    Rows collapse to one row per distinct score first, so a frequent score is no hot spot. The
    distinct scores are then cut into ranges: pairs inside a range come from a running sum within
    it, pairs across ranges from the totals of the ranges.
    """
    by = list(by)
    clean = df.select(*by, F.col(score).cast("double").alias("_s"), (F.col(label) == 1).cast("int").alias("_y"))
    splits = range_splits(clean, "_s")
    tied = clean.groupBy(*by, "_s").agg(
        F.sum("_y").alias("_pos"), F.sum(F.lit(1) - F.col("_y")).alias("_neg")
    )
    ranged = with_range(tied, "_s", splits, "_b")
    inside = Window.partitionBy(*by, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum("_neg").over(inside) - F.col("_neg")
    won = F.col("_pos").cast("double") * (below.cast("double") + F.col("_neg") / F.lit(2.0))
    parts = (
        ranged.withColumn("_won", won)
        .groupBy(*by, "_b")
        .agg(F.sum("_won").alias("_won"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("_neg").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_neg")
    total = F.sum(F.col("_won") + F.col("_pos").cast("double") * F.col("_before").cast("double"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return parts.withColumn("_before", before).groupBy(*by).agg(ratio(total, pairs).alias("auc"))


SCORE_NAMES = ("auc", "hinge_loss", "log_loss", "accuracy", "precision", "recall", "f1")


def evaluate(df: DataFrame, label: str, score: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """The seven scores of probabilities, one row per group: one aggregate plus the AUC."""
    by = list(by)
    predicted = (F.col(score) >= threshold).cast("int")
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        hinge_loss(label, score).alias("hinge_loss"),
        log_loss(label, score).alias("log_loss"),
        *confusion_counts(label, predicted),
    )
    base = sums.select(*by, "rows", "hinge_loss", "log_loss", *report_columns()[:4])
    auc = roc_auc(df, label, score, by)
    # both sides hold one row per group
    joined = base.join(auc, by, "left") if by else base.withColumn("auc", auc.scalar())
    return joined.select(*by, "rows", *SCORE_NAMES)
