"""Document fingerprints from prefix polynomial hashes.

Modular prefix arrays (two primes below 2^31) answer the equality of any two spans in constant time; longest common
extensions come by binary search. A fingerprint is the length, the hash of the whole text, and the ``SKETCH`` smallest
mixed hashes of all spans of ``SPAN`` code points. Null texts count as empty. The next document is the one of the next
smaller id (null ids last, equal ids by text hash), cyclically; a single row is its own next. Repeated rows stay rows
of their own; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tierblend.llm.base import query, settle, table, text_or_empty
from tierblend.session import ship_by_value

ship_by_value(__name__)

PRIMES, BASES, SPAN, SKETCH = (2147483629, 2147483587), (911382323, 972663749), 12, 64
#: Rows per range of ids; each range is one sorted stream.
RANGE_ROWS = 20_000

_powers: dict[int, np.ndarray] = {}


def powers(n: int, which: int) -> np.ndarray:
    held = _powers.get(which)
    if held is None or len(held) < n:
        p, size = np.uint64(PRIMES[which]), 1 << max(12, (n - 1).bit_length())
        held = np.ones(1, dtype=np.uint64)
        step = BASES[which]
        while len(held) < size:  # doubling: powers[m + i] = powers[i] * base^m
            held = np.concatenate([held, held * np.uint64(pow(step, len(held), int(p))) % p])
        _powers[which] = held
    return held[:n]


class Prefix:
    """H[i] = sum of code[j] * base^j for j < i; spans compare after scaling to a common power."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for w, p in enumerate(PRIMES):
            terms = codes * powers(max(1, self.n), w)[:self.n] % np.uint64(p)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % np.uint64(p)]))

    def span(self, start: int, end: int, scale: int) -> tuple[int, ...]:
        """Hash of [start, end) times base^(scale - start)."""
        out = []
        for w, p in enumerate(PRIMES):
            raw = (int(self.sums[w][end]) - int(self.sums[w][start])) % p
            out.append(raw * int(powers(scale - start + 1, w)[-1]) % p)
        return tuple(out)

    def equal(self, i: int, other: Prefix, j: int, length: int) -> bool:
        top = max(i, j)
        return self.span(i, i + length, top) == other.span(j, j + length, top)

    def extension(self, i: int, other: Prefix, j: int) -> int:
        """Length of the longest common extension from i and j."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def sketch(self) -> np.ndarray:
        """Smallest distinct mixed hashes of all spans of SPAN code points (the whole text, when shorter)."""
        width = min(SPAN, self.n)
        if width == 0:
            return np.zeros(0, np.uint64)
        count = self.n - width + 1
        mixed = np.zeros(count, np.uint64)
        for w, p in enumerate(PRIMES):
            p64 = np.uint64(p)
            raw = (self.sums[w][width:] + p64 - self.sums[w][:count]) % p64
            raw = raw * powers(count, w)[::-1] % p64  # times base^(count - 1 - start), then back to a fixed scale
            raw = raw * np.uint64(pow(pow(BASES[w], count - 1, p), -1, p)) % p64
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + raw
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        if count > 8 * SKETCH:  # repeated spans share a hash, so more than SKETCH of the smallest are looked at first
            few = np.unique(np.partition(mixed, 4 * SKETCH)[:4 * SKETCH])
            if len(few) > SKETCH:
                return few[:SKETCH]
        return np.unique(mixed)[:SKETCH]


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    own = Prefix(text)
    a, b = own.span(0, own.n, 0) if own.n else (0, 0)
    sketch = own.sketch()
    return f"{own.n}:{a:08x}{b:08x}:" + ",".join(f"{int(x):016x}" for x in sketch), sketch


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common spans among the smallest of both (a bottom-k estimate of the Jaccard likeness)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    both = both[:min(SKETCH, len(both))]
    return float(np.isin(both, a).astype(int) @ np.isin(both, b).astype(int)) / len(both)


def edit(text: str, following: str) -> str:
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


FIELDS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(frames):
    """Rows in order; each one is compared with the one after it. A row with ``tail`` only serves as a next one."""
    last = None
    for frame in frames:
        rows = []
        for doc_id, text, tail in zip(frame["doc_id"], frame["text"], frame["tail"]):
            mark, sketch = fingerprint(text)
            if last is not None:
                old_id, old, old_mark, old_sketch = last
                changed = edit(old, text)
                new_mark, new_sketch = fingerprint(changed)
                rows.append((old_id, len(old), hashlib.sha256(changed.encode()).hexdigest(), old_mark, new_mark,
                             likeness(old_sketch, new_sketch), likeness(old_sketch, sketch)))
            last = None if tail else (None if pd.isna(doc_id) else int(doc_id), text, mark, sketch)
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def compare_with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Ranges of descending id are sorted streams; the first row of each is also sent to the end of the one before.

    The row that opens a range has its largest id, so its id alone (a number per range) goes through the driver.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    total, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(12, math.ceil(total / range_rows))
    cuts = sorted({int(c) for c in rows.where("doc_id is not null").approxQuantile(
        "doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))}) if total > nulls else []
    below = F.lit(len(cuts) + 1)  # null ids come after all others
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c > F.col("doc_id")))
    placed = rows.withColumn("part", F.when(F.col("doc_id").isNull(), below).otherwise(place).cast("int"))
    order = F.xxhash64("text")
    heads = settle(placed.groupBy("part").agg(F.max(F.struct(F.col("doc_id"), (-order.cast("decimal(20,0)")).alias("h")))
                                              .alias("m")).select("part", "m.*"), "fingerprint-heads")
    parts = sorted(r[0] for r in heads.select("part").collect())
    before = {p: parts[i - 1] for i, p in enumerate(parts)}
    moved = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, target int")
    tails = (placed.withColumn("h", -order.cast("decimal(20,0)")).alias("a")
             .join(F.broadcast(heads.alias("b")), (F.col("a.part") == F.col("b.part"))
                   & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")))
             .select("a.doc_id", "a.text", "a.part").dropDuplicates(["part"])
             .join(F.broadcast(moved), "part").select("doc_id", "text", F.col("target").alias("part"), F.lit(1).alias("tail")))
    return (placed.withColumn("tail", F.lit(0)).unionByName(tails)
            .repartition(max(12, len(parts)), "part")
            .sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), order)
            .mapInPandas(_compare, FIELDS))


@query()
def op8_fingerprints(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))
