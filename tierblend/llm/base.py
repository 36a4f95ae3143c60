"""Helpers shared by the text operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierblend.session import settle  # noqa: F401  (general helper, used by the operators)

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            CHECKS[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower case of A-Z only; other letters stay."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with further underscores in front until no column of ``df`` has the name (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Fewer rows per Arrow batch while texts go to Python workers in this block, so that a batch of them stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
