"""Approximate nearest-neighbour join over several random-projection hash tables.

Every table cuts the space by random directions, each at the median of the targets' projections, so that buckets are
of like size. A query visits, in every table, the bucket of its own code and those reached by flipping the bits it is
least sure of (the ones with small distances to their cuts). Within a bucket exact distances are computed in blocks and
only the k best of a query leave it, so no bucket is expanded into its pairs.

Tables, bits and visited buckets are chosen at fitting: the exact neighbours of some queries are found in one scan of
all targets, and the cheapest setting that finds the wanted share of them is taken. Without any bits there is one
bucket per table and the join is exact, so a setting always exists.

Equal vectors are one row throughout, and buckets with many rows on either side are met in slices: neither copies nor
near copies of one vector gather in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierblend.functions.columns import hash_order
from tierblend.operators.neighbours import _best_in_chunk, _matrix
from tierblend.session import settle, ship_by_value

ship_by_value(__name__)

#: Vectors that place the cuts, and queries whose exact neighbours choose the setting; both come to the driver.
CUT_VECTORS, TUNED_QUERIES = 2_000, 128
#: Most tables and bits; flipped bits are chosen among the ``FLIPS`` least sure ones of a code.
MAX_TABLES, MAX_BITS, FLIPS = 16, 24, 10
#: Rows of a bucket that meet in one task (fewer where the vectors are long), pieces into which answers of copied
#: queries are spread.
SLICE_ROWS, SALTS = 65_536, 16
#: Most bytes of the vectors of a slice, as numbers of 8 bytes.
SLICE_BYTES = 64 << 20
#: What a visit costs beside the distances computed in it, in distances.
_VISIT = 50


@dataclass(frozen=True)
class HashTables:
    """Directions ``(table, bit, dimension)``, their cuts, the number of visited buckets and the measured recall."""

    normals: np.ndarray
    cuts: np.ndarray
    visits: int
    recall: float

    @property
    def tables(self) -> int:
        return self.normals.shape[0]

    @property
    def bits(self) -> int:
        return self.normals.shape[1]


def _sides(x: np.ndarray, normals: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Signed distances to the cuts: ``(table, row, bit)``."""
    return np.einsum("nd,tbd->tnb", x, normals) - cuts[:, None, :]


def _codes(sides: np.ndarray) -> np.ndarray:
    weight = np.left_shift(np.int64(1), np.arange(sides.shape[2], dtype=np.int64))
    return ((sides > 0) * weight).sum(axis=2, dtype=np.int64)


def _flips(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per table and row: the least sure bits, their squared distances, and the price of every subset of them."""
    many = min(FLIPS, sides.shape[2])
    price = sides * sides
    bits = np.argsort(price, axis=2, kind="stable")[:, :, :many]
    price = np.take_along_axis(price, bits, axis=2)
    subsets = (np.arange(1 << many)[:, None] >> np.arange(many)[None, :]) & 1
    return bits, subsets, price @ subsets.T.astype(float)


def _visited(sides: np.ndarray, visits: int) -> np.ndarray:
    """Codes to visit, own code first: ``(table, row, visit)``."""
    bits, subsets, price = _flips(sides)
    order = np.argsort(price, axis=2, kind="stable")[:, :, :visits]
    masks = np.left_shift(np.int64(1), bits.astype(np.int64)) @ subsets.T.astype(np.int64)
    return _codes(sides)[:, :, None] ^ np.take_along_axis(masks, order, axis=2)


def _visits_needed(q_sides: np.ndarray, v_sides: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per table and (query, neighbour) pair: visits until the neighbour's bucket is reached, infinite beyond ``FLIPS``."""
    bits, _, price = _flips(q_sides)
    ordered = np.sort(price, axis=2)
    differ = (q_sides > 0)[:, owner, :] != (v_sides > 0)
    inside = np.take_along_axis(differ, bits[:, owner, :], axis=2)
    kept = np.take_along_axis(q_sides * q_sides, bits, axis=2)[:, owner, :]
    cost = (kept * inside).sum(axis=2)
    out = np.full(cost.shape, np.inf)
    for t in range(cost.shape[0]):
        for i in range(cost.shape[1]):
            if inside[t, i].sum() == differ[t, i].sum():
                # equal prices may be visited in any order: count them all
                out[t, i] = np.searchsorted(ordered[t, owner[i]], cost[t, i] * (1 + 1e-12), side="right")
    return out


def _nearest_of_few(targets: DataFrame, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query position, vector)`` of the k nearest targets at a distance above 0, from one scan."""
    shared = targets.sparkSession.sparkContext.broadcast(queries)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = [(np.zeros(0), np.zeros((0, q.shape[1])))] * len(q)
        for batch in it:
            x = _matrix(batch.column("vec"))
            d2 = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2.0 * q @ x.T
            for i in range(len(q) if len(x) else 0):
                some = np.argpartition(d2[i], min(2 * k, len(x) - 1))[: 2 * k + 1]
                exact = ((x[some] - q[i]) ** 2).sum(axis=1)
                some, exact = some[exact > 0], exact[exact > 0]
                d = np.concatenate([best[i][0], exact])
                keep = np.argsort(d, kind="stable")[:k]
                best[i] = (d[keep], np.concatenate([best[i][1], x[some]])[keep])
        for i, (d, v) in enumerate(best):
            if len(d):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(d), i, np.int32)), pa.array(d), pa.array(list(v), type=pa.list_(pa.float64()))],
                    names=["q", "d", "vec"],
                )

    w = Window.partitionBy("q").orderBy("d", "vec")
    found = targets.select("vec").mapInArrow(scan, "q int, d double, vec array<double>")
    rows = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "vec").collect()
    shared.unpersist()
    return np.array([r["q"] for r in rows], dtype=int), np.array([r["vec"] for r in rows], dtype=np.float64)


def _some(df: DataFrame, rows: int, seed: int) -> np.ndarray:
    """The ``rows`` vectors of smallest key hash."""
    picked = df.select("vec", hash_order("id", seed).alias("_h")).orderBy("_h").limit(rows).collect()
    return np.array([r["vec"] for r in picked], dtype=np.float64)


def _fit(queries: DataFrame, targets: DataFrame, k: int, recall: float, seed: int, bits: int | None) -> HashTables:
    size = targets.count()
    sample = _some(targets, CUT_VECTORS, seed)
    tuned = _some(queries, TUNED_QUERIES, seed + 1)
    most = int(min(MAX_BITS, max(0, np.ceil(np.log2(max(1, size) / 16))))) if bits is None else bits
    normals = np.random.default_rng(seed).normal(size=(MAX_TABLES, most, sample.shape[1]))
    cuts = np.median(_sides(sample, normals, np.zeros((MAX_TABLES, most))), axis=1) if most else np.zeros((MAX_TABLES, 0))
    owner, near = _nearest_of_few(targets, tuned, k)
    exact = HashTables(normals[:1, :0], cuts[:1, :0], 1, 1.0)
    if not len(owner):
        return exact
    q_sides, v_sides = _sides(tuned, normals, cuts), _sides(near, normals, cuts)
    best, price = exact, float(size + _VISIT) if bits is None else np.inf
    for b in range(1, most + 1) if bits is None else [bits]:
        needed = _visits_needed(q_sides[:, :, :b], v_sides[:, :, :b], owner)
        for tables in (1, 2, 4, 8, MAX_TABLES):
            first = np.sort(needed[:tables].min(axis=0))
            visits = first[int(np.ceil(recall * len(first))) - 1]
            if np.isfinite(visits):
                cost = tables * visits * (size / 2.0**b + _VISIT)
                if cost < price:
                    got = float((first <= visits).mean())
                    best, price = HashTables(normals[:tables, :b], cuts[:tables, :b], int(visits), got), cost
    return best


def _known(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, vec)`` of the rows that have both; adding 0 makes -0.0 and 0.0 one value. Short numbers stay short."""
    number = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    vec = F.transform(F.col(vector).cast(f"array<{number}>"), lambda x: x + F.lit(0.0).cast(number))
    rows = df.select(F.col(key).alias("id"), vec.alias("vec"))
    return rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull())


def _vectors(rows: DataFrame, name: str) -> DataFrame:
    """One row per vector, under its smallest key."""
    return settle(rows.groupBy("vec").agg(F.min("id").alias("id")), name)


def _bucketed(df: DataFrame, index: HashTables, visits: int) -> DataFrame:
    """One row per visited bucket: ``(id, vec, tab, code)``."""
    shared = df.sparkSession.sparkContext.broadcast((index.normals, index.cuts))
    kind, vec = (df.schema[c].dataType.simpleString() for c in ("id", "vec"))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, cuts = shared.value
        step = max(1, min(1024, 16_384 // visits))
        for whole in it:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                x = _matrix(b.column("vec"))
                row = pa.array(np.repeat(np.arange(len(x)), visits))
                for t in range(len(normals)):
                    codes = _visited(_sides(x, normals[t : t + 1], cuts[t : t + 1]), visits)[0].reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(row), b.column("vec").take(row),
                         pa.array(np.full(len(codes), t, np.int32)), pa.array(codes)],
                        names=["id", "vec", "tab", "code"],
                    )

    return df.select("id", "vec").mapInArrow(place, f"id {kind}, vec {vec}, tab int, code bigint")


def _load(df: DataFrame, index: HashTables, visits: int, name: str) -> DataFrame:
    """Visits per bucket as ``(tab, code, name)``, counted without sending the vectors anywhere."""
    shared = df.sparkSession.sparkContext.broadcast((index.normals, index.cuts))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, cuts = shared.value
        step = max(1, min(1024, 16_384 // visits))
        for whole in it:
            for start in range(0, whole.num_rows, step):
                x = _matrix(whole.slice(start, step).column("vec"))
                for t in range(len(normals)):
                    codes, n = np.unique(_visited(_sides(x, normals[t : t + 1], cuts[t : t + 1]), visits), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(codes), t, np.int32)), pa.array(codes), pa.array(n)], names=["tab", "code", "n"])

    return df.select("vec").mapInArrow(place, "tab int, code bigint, n bigint").groupBy("tab", "code").agg(F.sum("n").alias(name))


def _cut(rows: DataFrame, crowded: DataFrame, mine: str, other: str) -> DataFrame:
    """Rows with their own slice of a crowded bucket, repeated for every slice of the other side.

    The pieces of crowded buckets are looked up with salts, as these buckets are the frequent keys.
    """
    salt = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(SALTS)).cast("int")
    spread = crowded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", salt).join(spread, ["tab", "code", "salt"], "left").drop("salt")
    own, across = F.coalesce(F.col(f"{mine}s"), F.lit(1)), F.coalesce(F.col(f"{other}s"), F.lit(1))
    return joined.select(
        "id", "vec", "tab", "code", F.pmod(F.xxhash64("id"), own).cast("int").alias(mine),
        F.explode(F.sequence(F.lit(0), (across - 1).cast("int"))).alias(other),
    )


def nearest_hashed(
    queries: DataFrame,
    targets: DataFrame,
    k: int,
    key: str = "ID",
    vector: str = "features",
    recall: float = 0.95,
    seed: int = 7,
    bits: int | None = None,
    index: HashTables | None = None,
) -> DataFrame:
    """About the k nearest targets of every query: ``(query, neighbour, rank, distance)``, distances exact.

    ``recall`` is the share of true neighbours to be found, as measured at fitting on ``TUNED_QUERIES`` queries against
    all targets (:func:`fit_tables` returns it); ``bits`` fixes the length of the codes, which otherwise follows from the
    costs (small tables without structure are met whole). Equal distances are ranked by key. Rows whose key or vector is null
    are left out on both sides; empty tables give no rows. A key names one vector; repeated rows count once. A query gets fewer than k rows where its buckets hold fewer. Other columns are not read.
    """
    kind = queries.schema[key].dataType.simpleString()
    q_all, t_all = _known(queries, key, vector), _known(targets, key, vector)
    q, t = _vectors(q_all, "query-vectors"), _vectors(t_all, "target-vectors")
    if q.isEmpty() or t.isEmpty():
        return queries.sparkSession.createDataFrame([], f"query {kind}, neighbour {kind}, rank int, distance double")
    index = index or _fit(q, t, k, recall, seed, bits)
    left, right = _bucketed(q, index, index.visits), _bucketed(t, index, 1)

    slice_rows = max(1, min(SLICE_ROWS, SLICE_BYTES // (8 * max(1, index.normals.shape[2]))))
    load = _load(q, index, index.visits, "q").join(_load(t, index, 1, "t"), ["tab", "code"])
    parts = [F.ceil(F.col(c) / F.lit(slice_rows)).cast("int").alias(f"{c}s") for c in "qt"]
    crowded = settle(load.filter(F.greatest("q", "t") > slice_rows).select("tab", "code", *parts), "crowded")
    on = ["tab", "code", "q", "t"]
    left, right = _cut(left, crowded, "q", "t"), _cut(right, crowded, "t", "q")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        row = col = np.zeros(0, dtype=np.int64)
        dist = np.zeros(0)
        if a.num_rows and b.num_rows:
            order = np.argsort(np.argsort(b.column("id").to_numpy(), kind="stable"), kind="stable")
            row, col, dist = _best_in_chunk(
                _matrix(a.column("vec")), _matrix(b.column("vec")), order, k, np.full(a.num_rows, np.inf))
        take_a, take_b = pa.array(row, type=pa.int64()), pa.array(col, type=pa.int64())
        return pa.table({"q": a.column("id").take(take_a), "t": b.column("id").take(take_b), "distance": pa.array(dist, type=pa.float64())})

    t_kind = targets.schema[key].dataType.simpleString()
    pairs = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, f"q {kind}, t {t_kind}, distance double")
    best = Window.partitionBy("q").orderBy("distance", "t")
    found = (pairs.groupBy("q", "t").agg(F.min("distance").alias("distance"))
             .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"))
    return _expanded(found, q, t, q_all, t_all, k)


def _expanded(found: DataFrame, q: DataFrame, t: DataFrame, q_all: DataFrame, t_all: DataFrame, k: int) -> DataFrame:
    """From distinct vectors back to rows: copies of a target up to k, answers to every copy of a query."""
    first = Window.partitionBy("vec").orderBy("id")
    copies = t_all.distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    member = t.withColumnRenamed("id", "t").join(copies.withColumnRenamed("id", "neighbour"), "vec").select("t", "neighbour")
    best = Window.partitionBy("q").orderBy("distance", "neighbour")
    ranked = found.join(member, "t").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    answers = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "distance"))).alias("a"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    answers = q.withColumnRenamed("id", "q").join(answers, "q").select("vec", "a", salts.alias("salt"))
    asked = q_all.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    out = asked.join(answers, ["vec", "salt"]).select(F.col("id").alias("query"), F.explode("a").alias("a"))
    return out.select("query", "a.neighbour", "a.rank", "a.distance")


def fit_tables(queries: DataFrame, targets: DataFrame, k: int, key: str = "ID", vector: str = "features",
               recall: float = 0.95, seed: int = 7, bits: int | None = None) -> HashTables:
    """The setting that :func:`nearest_hashed` would choose, to be looked at or used again with ``index``."""
    q, t = _vectors(_known(queries, key, vector), "query-vectors"), _vectors(_known(targets, key, vector), "target-vectors")
    return _fit(q, t, k, recall, seed, bits)
