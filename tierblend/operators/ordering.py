"""Ranks and order statistics without a single-task sort.

Every function splits the ordered domain into ranges, counts the ranges (one aggregate with map-side
combination) and then looks only inside the ranges that matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierblend.functions.columns import hash_order
from tierblend.session import BROADCAST_ROWS, bucket_count, small_rows

# Fixed value: hash ranges are formed by this many leading hex digits (16**4 ranges).
HASH_PREFIX = 4


def range_splits(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Inner boundaries of about ``buckets`` equally filled ranges of a numeric column."""
    b = buckets or bucket_count(df.sparkSession)
    probs = [i / b for i in range(1, b)]
    found = df.approxQuantile(column, probs, 1.0 / (4 * b)) or []
    return sorted({x for x in found if x == x and abs(x) != float("inf")})


def with_range(df: DataFrame, column: str, splits: Sequence[float], name: str) -> DataFrame:
    """Add the ordinal of the range a numeric value falls into; NaN goes to the last range."""
    edges = [float("-inf"), *splits, float("inf")]
    if len(edges) < 3:
        return df.withColumn(name, F.when(F.isnan(column), 1).otherwise(0))
    tool = Bucketizer(splits=edges, inputCol=column, outputCol=name, handleInvalid="keep")
    return tool.transform(df).withColumn(name, F.col(name).cast("int"))


def order_statistics(
    df: DataFrame,
    value: str,
    bucket: str,
    ranks: Callable[[Column], Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Values at given 1-based ranks, exact, per group.

    ``bucket`` is a column of ``df`` that grows with ``value``. ``ranks`` maps the row count of a
    group to an array of ranks. Returns ``(*by, ordinal, value, total)``, ``ordinal`` being the
    position in that array; ranks outside 1..total give no row.
    """
    by = list(by)
    hist = df.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    # at most one row per range and group reaches these windows
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    hist = (
        hist.withColumn("_hi", F.sum("_n").over(group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("_n").over(group))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )
    targets = (
        hist.select(*by, bucket, "_lo", "_hi", "total", F.posexplode(ranks(F.col("total"))).alias("ordinal", "_rank"))
        .filter((F.col("_lo") < F.col("_rank")) & (F.col("_rank") <= F.col("_hi")))
        .select(*by, bucket, "ordinal", "total", (F.col("_rank") - F.col("_lo")).alias("_need"))
    )
    rows = small_rows(targets)
    if rows is not None:
        targets = F.broadcast(df.sparkSession.createDataFrame(rows, targets.schema))
    inside = df.select(*by, bucket, value).join(targets, [*by, bucket])
    # equal values collapse into one row before anything is ordered
    inside = inside.groupBy(*by, bucket, "ordinal", "total", "_need", value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by, bucket, "ordinal").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        inside.withColumn("_run", F.sum("_c").over(w))
        .filter((F.col("_run") - F.col("_c") < F.col("_need")) & (F.col("_need") <= F.col("_run")))
        .select(*by, "ordinal", F.col(value).alias("value"), "total")
    )


def numeric_order_statistics(df: DataFrame, column: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """:func:`order_statistics` of a whole numeric column; nulls are left out."""
    kept = df.select(column).filter(F.col(column).isNotNull())
    double = kept.withColumn("_d", F.col(column).cast("double"))
    splits = range_splits(double, "_d")
    return order_statistics(with_range(double, "_d", splits, "_b"), column, "_b", ranks)


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between the two neighbouring order statistics."""

    def ranks(n: Column) -> Column:
        wanted: list[Column] = []
        for p in probs:
            h = (n - 1).cast("double") * F.lit(float(p))
            wanted += [F.floor(h) + 1, F.least(F.floor(h) + 2, n)]
        return F.array(*[w.cast("bigint") for w in wanted])

    values = df.select(F.col(column).cast("double").alias("_x")).filter(~F.isnan("_x"))
    found = {r["ordinal"]: (r["value"], r["total"]) for r in numeric_order_statistics(values, "_x", ranks).collect()}
    out: list[float | None] = []
    for i, p in enumerate(probs):
        if 2 * i not in found:
            out.append(None)
            continue
        (lo, n), (hi, _) = found[2 * i], found[2 * i + 1]
        h = (n - 1) * float(p)
        out.append(lo + (h - int(h)) * (hi - lo))
    return out


def with_row_number(df: DataFrame, key: str, name: str = "ID", start: int = 0) -> DataFrame:
    """Number the rows ``start, start+1, ...`` in the order of a unique key.

    Ranges of the key are numbered independently and shifted by the counts of the ranges before
    them, so no task holds more than one range.
    """
    work = df.withColumn("_k", F.col(key).cast("double"))
    if isinstance(df.schema[key].dataType, T.NumericType):
        work = with_range(work, "_k", range_splits(work, "_k"), "_b")
    else:
        work = with_text_range(df, key, "_b")
    counts = {r["_b"]: r["count"] for r in work.groupBy("_b").count().collect()}
    offset, shift = start, {}
    for b in sorted(counts):
        shift[b] = offset
        offset += counts[b]
    table = [shift.get(b, 0) for b in range(max(counts, default=0) + 1)]
    ordinal = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    base = F.element_at(F.lit(table).cast("array<bigint>"), F.col("_b") + 1)
    numbered = work.withColumn(name, base + ordinal.cast("bigint") - 1)
    return numbered.select(name, *df.columns)


def with_text_range(df: DataFrame, key: str, name: str) -> DataFrame:
    """Ranges of a non-numeric unique key, with boundaries read from a repeatable hash sample."""
    b = bucket_count(df.sparkSession)
    cut = f"{key}_cut"
    low = hash_order(key, 7)
    sample = df.select(F.col(key).alias(cut), low.alias("_h")).orderBy("_h").limit(b - 1)
    bounds = sorted(r[cut] for r in sample.select(cut).collect())
    if not bounds:
        return df.withColumn(name, F.lit(0))
    edges = F.array(*[F.lit(x) for x in bounds])
    return df.withColumn(name, F.size(F.filter(edges, lambda e: e < F.col(key))))


def hash_cuts(
    df: DataFrame,
    key: str,
    seed: int,
    ranks: Callable[[Column], Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(*by, ordinal, value=(hash, key), total)``: where the hash order of a group is cut."""
    h = hash_order(key, seed)
    work = df.select(*by, F.struct(h.alias("h"), F.col(key).alias("k")).alias("_v"))
    work = work.withColumn("_b", F.substring("_v.h", 1, HASH_PREFIX))
    return order_statistics(work, "_v", "_b", ranks, by)


def hash_segment(
    df: DataFrame,
    key: str,
    seed: int,
    ranks: Callable[[Column], Column],
    name: str,
    by: str | None = None,
) -> DataFrame:
    """Add the ordinal of the hash-ordered segment each row falls into.

    ``ranks`` gives the last rank of every segment but the final one. The rows themselves are not
    shuffled: once the cuts are known the segment is a comparison of each row with constants. Only
    with more groups than can be held as constants the cuts are joined.
    """
    groups = [by] if by else []
    cuts = hash_cuts(df, key, seed, ranks, groups)
    mine = F.struct(hash_order(key, seed).alias("h"), F.col(key).alias("k"))
    rows = small_rows(cuts, 2_000)
    if rows is not None:
        key_type = df.schema[key].dataType

        def above(r) -> Column:
            cut = F.struct(F.lit(r["value"]["h"]).alias("h"), F.lit(r["value"]["k"]).cast(key_type).alias("k"))
            return (mine > cut).cast("int")

        def passed(some: list) -> Column:
            total = F.lit(0)
            for r in some:
                total = total + above(r)
            return total

        if not by:
            return df.withColumn(name, passed(rows))
        values = sorted({r[by] for r in rows}, key=str)
        chain = None
        for v in values:
            here = passed([r for r in rows if r[by] == v])
            cond = F.col(by) == F.lit(v)
            chain = F.when(cond, here) if chain is None else chain.when(cond, here)
        # a group with no cut is smaller than the number of segments minus one: all in segment 0
        return df.withColumn(name, F.lit(0) if chain is None else F.coalesce(chain.otherwise(F.lit(0)), F.lit(0)))
    packed = cuts.groupBy(*groups).agg(F.collect_list("value").alias("_cuts"))
    joined = df.join(packed, groups, "left")
    seg = F.coalesce(F.size(F.filter("_cuts", lambda c: c < mine)), F.lit(0))
    return joined.withColumn(name, seg).select(*df.columns, name)


__all__ = [
    "BROADCAST_ROWS",
    "exact_quantiles",
    "hash_cuts",
    "hash_segment",
    "numeric_order_statistics",
    "order_statistics",
    "range_splits",
    "with_range",
    "with_row_number",
    "with_text_range",
]
