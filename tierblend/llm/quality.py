"""Quality classifier: learned vectors of hashed words, word pairs and character n-grams, averaged per document, softmax.

Fitted by stochastic gradient descent in numpy on at most ``SAMPLE`` labelled documents (those with the smallest hash of
their id), the one bound here. Scoring covers every row and whole texts. Null texts count as empty; a text without
n-grams scores the share of label 1. Repeated rows get equal scores. Without any labelled row all score 0.5; with one
class only, its share. Labels that are null are not learnt from. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tierblend.llm.base import free_name, query, table, text_or_empty
from tierblend.session import ship_by_value

ship_by_value(__name__)

SAMPLE, BUCKETS, WIDTH, EPOCHS, RATE, SEED, THRESHOLD = 4_000, 1 << 15, 8, 8, 0.5, 11, 0.3
SAME = 1
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts are hashed in slices of so many code points, whose n-grams overlap, to bound memory.
SLICE = 1 << 18


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def _fold(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def _ids(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.uint64)
    out = []
    for n in (2, 3, 4):
        if len(codes) >= n:
            h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
            for j in range(n):
                h = h * BASE + codes[j:len(codes) - n + 1 + j]
            out.append(_fold(h + np.uint64(n)))
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if len(start):
        place = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes))))[
            -len(codes):] if start[0] == 0 else np.maximum(
            0, np.arange(len(codes)) - np.repeat(np.insert(start, 0, 0), np.diff(np.append(np.insert(start, 0, 0), len(codes)))))
        part = np.where(space, np.uint64(0), codes * _POWERS[place % len(_POWERS)])
        word = np.add.reduceat(part, start)
        out.append(_fold(word * BASE + np.uint64(77)))
        pair = _fold(word[:-1] * BASE + word[1:] * np.uint64(31) + np.uint64(78))
        out.append(np.where(word[:-1] == word[1:], SAME, pair))  # a word said twice in a row is a pair of its own kind
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares in the whole text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) <= SLICE:
        counts = np.bincount(_ids(codes), minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for at in range(0, len(codes), SLICE):
            counts += np.bincount(_ids(codes[at:at + SLICE + 3]), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, counts.sum())


def fit(bags: list, labels: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Per-bucket log-odds and offset. With a linear output, the averaged vector's logit is the average of these."""
    if not len(labels):
        return np.zeros(BUCKETS), 0.0
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS), prior
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    out = np.zeros((WIDTH, 2))
    shift = np.array([0.0, prior])
    epochs = max(EPOCHS, -(-EPOCHS * SAMPLE // len(bags)))  # as many steps for a small sample as for a full one
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, share_of = bags[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share_of @ vectors[at] if len(at) else np.zeros(WIDTH)
            z = np.clip(hidden @ out + shift, -40, 40)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            shift -= 0.1 * rate * p
            if len(at):
                # shares are small numbers: the vectors move at a rate per document, not per n-gram
                vectors[at] -= rate * 50 * np.outer(share_of, back)
    return vectors @ (out[:, 1] - out[:, 0]), float(shift[1] - shift[0])


def learn_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, wanted: bool, sample: int) -> DataFrame:
    """text and label of at most ``sample`` rows of the learning folds, by smallest hash."""
    mark = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held
    rows = (labels.select(F.col("doc_id").alias("_d"), F.col(label).cast("int").alias("label"))
            .where(F.col("label").isin(0, 1) & F.col("_d").isNotNull()).groupBy("_d").agg(F.max("label").alias("label"))
            .withColumn("doc_id", F.col("_d")).where(mark if wanted else ~mark)
            .join(docs.select(F.col("doc_id").alias("_k")).distinct(), F.col("_d") == F.col("_k"), "left_semi")
            .orderBy(F.xxhash64(F.lit(5), "_d"), "_d").limit(sample).select("_d", "label"))
    return (docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(rows), F.col("doc_id") == F.col("_d"))
            .groupBy("_d").agg(F.min("text").alias("text"), F.first("label").alias("label")))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0,
          sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on folds other than ``held``; only hashed bags of the bounded sample reach the driver."""
    @F.pandas_udf("ids binary, shares binary")  # packed: as lists of numbers they take ten times the memory
    def bags(texts: pd.Series) -> pd.DataFrame:
        found = [bag(t) for t in texts]
        return pd.DataFrame({"ids": [a.astype(np.int32).tobytes() for a, _ in found],
                             "shares": [b.astype(np.float32).tobytes() for _, b in found]})

    rows = (learn_rows(docs, labels, label, folds, held, False, sample)
            .select("_d", "label", bags("text").alias("b")).select("_d", "label", "b.*").toPandas().sort_values("_d"))
    return fit([(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(rows["ids"], rows["shares"])],
               rows["label"].to_numpy(dtype=np.int64))


def probability(spark, model: tuple[np.ndarray, float]):
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        odds, shift = shared.value
        out = []
        for t in texts:
            at, share = bag(t)
            out.append(1 / (1 + np.exp(-np.clip(odds[at] @ share + shift, -40, 40))))
        return pd.Series(out, dtype="float64")

    return score


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """All columns of ``docs`` and ``score`` (replacing a column of that name)."""
    return docs.withColumn("score", probability(docs.sparkSession, model)(text_or_empty()))


def held_out(folds: int, held: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))


@query()
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score",
                                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score ``threshold`` or more, with their columns."""
    model = train(docs, labels)
    score = free_name(docs, "_score")
    kept = docs.withColumn(score, probability(docs.sparkSession, model)(text_or_empty()))
    return kept.where(F.col(score) >= threshold).drop(score)
