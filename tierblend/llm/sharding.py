"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into blocks by a hash of their content, so that a lost task gives the same block again. From the blocks' sizes
the driver draws, exactly and by one seed, how many rows each block sends to each shard (a number per block and shard).
Each block orders its rows by a hash and deals them by these counts; each shard orders what it received by another
hash, in ranges of that hash. Law ``rows``: shard sizes differ by at most one. Null texts have size 1 and the CRC of
the empty text; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tierblend.llm.base import query, settle, table, text_or_empty

SHARDS, SEED = 16, 20_261
#: Rows that one block or one range of a shard holds on average; the number of blocks follows the table.
BLOCK_ROWS = 100_000


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[b, s] of a uniform shuffle: rows of block b that go to shard s."""
    total = sum(sizes)
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(sizes), shards), dtype=np.int64)
    for b, size in enumerate(sizes):
        rest, left = size, int(room.sum())
        for s in range(shards):  # conditional hypergeometric draws; numpy bounds their sums, so large ones are split
            left -= int(room[s])
            take = _draw(rng, int(room[s]), left, rest)
            out[b, s] = take
            rest -= take
        room -= out[b]
    return out


def _draw(rng, good: int, bad: int, picks: int) -> int:
    if good == 0 or picks == 0:
        return 0
    if bad == 0:
        return min(good, picks)
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, picks))
    mean = picks * good / (good + bad)
    var = mean * bad / (good + bad) * (good + bad - picks) / max(1, good + bad - 1)
    return int(min(good, picks, max(0, picks - bad, round(rng.normal(mean, math.sqrt(max(var, 0)))))))


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = text_or_empty()
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    slim = settle(slim, "shard-rows")
    total = slim.count()
    blocks = max(12, math.ceil(total / block_rows))
    key = F.xxhash64("doc_id", "text_crc32", "size")
    placed = slim.withColumn("_block", F.pmod(key, F.lit(blocks)).cast("int"))
    sizes = dict(placed.groupBy("_block").count().collect())  # one number per block
    order = sorted(sizes)
    counts = communication_matrix([sizes[b] for b in order], shards, seed)
    ends = np.cumsum(counts, axis=1)
    plan = spark.createDataFrame([(b, [int(x) for x in ends[i]]) for i, b in enumerate(order)],
                                 "_block int, _ends array<long>")
    inside = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), "doc_id", "text_crc32")
    dealt = (placed.withColumn("_n", F.row_number().over(inside))
             .join(F.broadcast(plan), "_block")
             .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_n"))).cast("int")))
    ranges = max(1, math.ceil(blocks / shards))
    mixed = F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32")
    dealt = settle(
        dealt.select("doc_id", "size", "text_crc32", "shard", mixed.alias("_mix"))
        .withColumn("_range", F.pmod(F.shiftrightunsigned(F.col("_mix"), 20), F.lit(ranges)).cast("int")), "shard-dealt")
    found = sorted(dealt.groupBy("shard", "_range").count().collect())  # about one number per block
    offsets, at, last = [], 0, None
    for shard, part, n in found:
        at = 0 if shard != last else at
        offsets.append((shard, part, at))
        at, last = at + n, shard
    starts = spark.createDataFrame(offsets, "shard int, _range int, _at long")
    again = Window.partitionBy("shard", "_range").orderBy("_mix", "doc_id", "text_crc32")
    return (dealt.withColumn("_n", F.row_number().over(again))
            .join(F.broadcast(starts), ["shard", "_range"])
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("_at") + F.col("_n") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


@query()
def op10_sharding(spark, sf_dir):
    return shuffle_shards(table(spark, sf_dir, "documents"))
