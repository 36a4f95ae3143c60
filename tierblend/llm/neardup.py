"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A text's shingles (five words, or all words when there are fewer) are hashed once; ``BINS`` bins keep their smallest
hash, and an empty bin takes that of a non-empty one found by hashing the bin's number (optimal densification). Bands
of ``ROWS`` bins give buckets. In each bucket a star joins a hub with every other member: a bucket of m members gives
m - 1 pairs. The hub is the member whose buckets hold the most texts, the most typical one of its group, so the buckets
of a group mostly share theirs and its pairs fall together.

Buckets that still hold more than one component are crowded by texts below the share. Their texts are split exactly:
shingles are ordered by how many of these texts hold them, and a text enters one group per shingle among its rarest
(any two linked texts share one of those, and its places in both leave room for enough common shingles). Groups go on
in rounds, with ``GROWTH`` times as many hubs in each, until none holds more than one component; a hub has then met
its whole group and leaves it. So any two members of a bucket are compared, are ruled out by sizes and places, or are
connected already: no link between members is lost, and no group is expanded into its pairs.

Pairs are first held against the sizes and against parity maps (one bit per class of hashes, flipped by each shingle:
two maps never differ in more bits than the sets in shingles), then confirmed on the full shingle sets.
Two texts at the threshold share no bucket with probability (1 - 0.85 ^ ROWS) ^ (BINS // ROWS), some 2e-9; at the
share ``CORPUS_SHARE`` of corpus stages some 3e-6.
Texts with equal shingle sets are joined first, so copies cost one row each and never meet in a bucket. Other texts
link only from ``least_linked`` shingles on (below, one different shingle is already too much) and go into no bucket
before.

Null texts, empty texts and texts without words have no shingles and are linked with nothing. Rows of one id share a
component; null ids are kept and never linked. Extra columns are not read by ``components``.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tierblend.llm.base import free_name, query, settle, table, text_or_empty
from tierblend.session import ship_by_value

ship_by_value(__name__)

BINS, ROWS, WORDS, SHARE, SEED = 256, 6, 5, 85, 97
#: The share from which a stage on a corpus takes two texts as near copies; ``SHARE`` is that of the query.
CORPUS_SHARE = 80
#: Hubs per group of a crowded bucket's texts in the first round, and their growth from round to round.
HUBS, GROWTH = 16, 16
#: Bits of the parity map of a text below four times as many shingles; four times the bits for each four times the length.
MAP_BITS = 512
#: Most ids of texts with a shared bucket that are broadcast to pick their texts; beyond, both sides are shuffled.
SENT = 4_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def _mix(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.full(max(n, 1024), _PRIME, dtype=np.uint64)
        _powers[0] = 1
        _powers = np.multiply.accumulate(_powers)
    return _powers


def _word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, A-Z lowered; white space is that of the contract's words, nothing else."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (codes == 32) | (codes - np.uint32(9) < 5)
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(begin):
        return np.zeros(0, np.uint64)
    codes, space, begin = codes[begin[0]:], space[begin[0]:], begin - begin[0]
    lower = codes + np.uint32(1) + (codes - np.uint32(65) < 26) * np.uint32(32)
    place = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))
    terms = lower * _power(int(place.max()) + 1)[place]
    terms[space] = 0
    return _mix(np.add.reduceat(terms, begin))


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    h = _word_hashes(text)
    if not len(h):
        return h
    width = min(size, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = _mix(out * _PRIME + h[j:len(h) - width + 1 + j] + np.uint64(width))
    return np.unique(out)


@functools.lru_cache(maxsize=64)
def _attempts(bins: int, turn: int) -> np.ndarray:
    """Bins that each bin tries, in order: 32 attempts of a turn as rows."""
    tries = np.arange(32 * turn, 32 * (turn + 1), dtype=np.uint64)[:, None] + np.uint64(1)
    return (_mix(np.arange(bins, dtype=np.uint64) * np.uint64(1_000_003) + tries * _PRIME) % np.uint64(bins)).astype(np.int64)


def signature(found: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Smallest hash per bin of one permutation; empty bins filled by optimal densification."""
    at = (((found >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)  # sorted, as ``found`` is
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out = np.zeros(bins, dtype=np.uint64)
    out[at[first]] = np.minimum.reduceat(_mix(found + np.uint64(SEED)), first)
    filled = np.zeros(bins, bool)
    filled[at] = True
    source = np.arange(bins)
    empty = np.flatnonzero(~filled)
    turn = 0
    while len(empty):
        picks = _attempts(bins, turn)[:, empty]
        good = filled[picks]
        found_at = good.argmax(axis=0)
        done = good[found_at, np.arange(len(empty))]
        source[empty[done]] = picks[found_at[done], np.flatnonzero(done)]
        empty = empty[~done]
        turn += 1
    return out[source]


def buckets(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` bins."""
    part = sig[:len(sig) // rows * rows].reshape(-1, rows)
    out = np.arange(len(part), dtype=np.uint64)
    for j in range(rows):
        out = _mix(out * _PRIME + part[:, j])
    return out.view(np.int64)


def least_linked(share: int) -> int:
    """Shingles that a set needs at least to be linked with a different one: k common of k + 1 must reach the share."""
    return math.ceil(share / (100 - share)) if share < 100 else 2**31 - 1


def parity_map(found: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words: whether an odd number of shingles falls on each."""
    bits = MAP_BITS
    while len(found) >= 4 * bits:
        bits *= 4
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketcher(least: int):
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = shingles(t)
            n, banded = len(found), len(found) >= least
            rows.append((n, hashlib.md5(found.tobytes()).digest() if n else None,
                         buckets(signature(found)) if banded else None, parity_map(found) if banded else None))
        return pd.DataFrame(rows, columns=["n", "mark", "keys", "map"])
    return F.pandas_udf(sketch, "n long, mark binary, keys array<long>, map array<long>")


def _full(texts: pd.Series) -> pd.DataFrame:
    found = [shingles(t) for t in texts]
    return pd.DataFrame({"mark": [hashlib.md5(f.tobytes()).digest() for f in found], "held": [f.view(np.int64) for f in found]})


def _tangled(edges: DataFrame) -> bool:
    """Whether any node has two lower neighbours, or a lower and a higher one: then the edges are no stars yet."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return not (ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
                .where((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("low") == 0))).isEmpty())


def _spread_labels(edges: DataFrame) -> DataFrame:
    """(u, r): smallest id r reachable from u, by alternating large-star and small-star steps until all edges are stars.

    ``edges`` are distinct and stored, with u > v.
    """
    while _tangled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = settle(large, "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select("v", "m", "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        edges = settle(small, "small-star")
    return edges.select("u", F.col("v").alias("r"))


def _relabel(df: DataFrame, map_: DataFrame) -> DataFrame:
    return (df.join(map_, F.col("root") == F.col("u"), "left").withColumn("root", F.coalesce("r", "root"))
            .drop("u", "r"))


def _confirmed(pairs: DataFrame, facts: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Distinct links (u, v) of ids, u > v, among the pairs (a, b) of texts that reach the share."""
    side = lambda k: facts.select(F.col("t").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "map", "root")])
    differ = F.aggregate(F.zip_with("map_a", "map_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # |A or B| - |A and B| is at most (100 - share) / (100 + share) of the sum of the sizes
    near = (F.size("map_a") != F.size("map_b")) | (differ * (100 + share) <= (F.col("n_a") + F.col("n_b")) * (100 - share))
    left = (pairs.join(side("a"), "a").join(side("b"), "b").where("root_a <> root_b")
            .where(F.greatest("n_a", "n_b") * share <= F.least("n_a", "n_b") * 100).where(near)
            .select("a", "b", F.greatest("root_a", "root_b").alias("u"), F.least("root_a", "root_b").alias("v")))
    met = (left.join(sets.select(F.col("t").alias("a"), F.col("held").alias("held_a")), "a")
           .join(sets.select(F.col("t").alias("b"), F.col("held").alias("held_b")), "b")
           .where((100 + share) * F.size(F.array_intersect("held_a", "held_b"))
                  >= share * (F.size("held_a") + F.size("held_b"))))
    return settle(met.select("u", "v").distinct(), "links")


def _rare_first(crowded: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(t, word, p): the rarest shingles of every crowded text that a linked text must share one of, and their places."""
    words = sets.join(crowded, "t", "left_semi").select("t", F.explode("held").alias("word"))
    common = words.groupBy("word").count().where("count > 1")
    # a text's own shingles at most are collected; those that no other text has only move the places
    ranked = (words.join(common, "word").groupBy("t")
              .agg(F.sort_array(F.collect_list(F.struct("count", "word"))).alias("f"))
              .join(crowded.select("t", "n"), "t").withColumn("alone", F.col("n") - F.size("f")))
    last = F.col("n") - F.floor((F.col("n") * share + 99) / 100) + 1
    return (ranked.withColumn("f", F.slice("f", 1, F.greatest(F.lit(0), last - F.col("alone")).cast("int")))
            .select("t", "alone", F.posexplode("f").alias("at", "e"))
            .select("t", "e.word", (F.col("alone") + F.col("at") + 1).alias("p")))


def components(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    sketched = settle(rows.select("doc_id", _sketcher(least_linked(share))("text").alias("s")).select("doc_id", "s.*"),
                      "sketches")
    # one row per distinct shingle set, under its smallest id (combined before the shuffle)
    classes = settle(sketched.where("mark is not null and doc_id is not null").groupBy("mark", "n")
                     .agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("map").alias("map"))
                     .withColumn("t", F.xxhash64("mark")), "classes")
    banded = classes.select("t", F.explode("keys").alias("bucket"))
    shared = banded.groupBy("bucket").count().where("count > 1")
    bands = settle(banded.join(shared, "bucket"), "bands")
    density = bands.groupBy("t").agg(F.sum("count").alias("density"))
    facts = settle(classes.join(density, "t").select("t", "n", "map", "density", "id", F.col("id").alias("root")), "facts")
    wanted = facts.select(F.col("id").alias("_i"), F.col("t").alias("_t"))
    picked = wanted.select("_i").distinct()
    if wanted.count() <= SENT:  # texts stay where they are
        picked = F.broadcast(picked)
    sets = settle(rows.join(picked, F.col("doc_id") == F.col("_i"), "left_semi")
                  .select(F.pandas_udf(_full, "mark binary, held array<long>")("text").alias("s"))
                  .select(F.xxhash64("s.mark").alias("t"), "s.held")
                  .join(wanted.select("_t"), F.col("t") == F.col("_t"), "left_semi").dropDuplicates(["t"]), "partner-sets")
    maps = []

    def link(pairs: DataFrame) -> bool:
        """Take in the links among the pairs; whether there were any."""
        nonlocal facts
        fresh = _confirmed(pairs, facts, sets, share)
        if fresh.isEmpty():
            return False
        maps.append(_spread_labels(fresh))
        facts = settle(_relabel(facts, maps[-1]), "facts")
        return True

    # one star per bucket
    hubs = (bands.join(facts.select("t", "density"), "t").groupBy("bucket")
            .agg(F.max(F.struct("density", "t")).alias("h")).select("bucket", F.col("h.t").alias("hub")))
    link(bands.join(hubs, "bucket").where("t <> hub")
         .select(F.least("t", "hub").alias("a"), F.greatest("t", "hub").alias("b")).distinct())
    # what is left in buckets of several components meets in groups of rare shingles
    rooted = bands.join(facts.select("t", "root"), "t")
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    crowded = settle(bands.join(several, "bucket", "left_semi").select("t").distinct()
                     .join(facts.select("t", "n"), "t"), "crowded")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "t"), 11) * F.lit(2.0 ** -53)
    groups = settle(_rare_first(crowded, sets, share).join(crowded, "t").withColumn("at", place), "rare-groups")
    hubs_wanted = float(HUBS)
    while True:
        open_ = groups.join(facts.select("t", "root"), "t")
        # the shorter text of a linked pair holds the shingle early enough for a text of its own size
        early = (F.col("n") - F.col("p") + 1) * (100 + share) >= F.col("n") * (2 * share)
        state = (open_.groupBy("word").agg(F.count("*").alias("m"), F.min("at").alias("first"), F.min("root").alias("low"),
                                           F.max("root").alias("high"), F.bool_or(early).alias("early"))
                 .where("low <> high and early")
                 .select("word", F.greatest("first", F.lit(hubs_wanted) / F.col("m")).alias("cut")))
        live = settle(open_.join(state, "word"), "open-groups")
        if live.isEmpty():
            break
        hub = live.where("at <= cut").select("word", *[F.col(c).alias(f"hub_{c}") for c in ("t", "n", "p", "root")])
        room = 1 + F.least(F.col("n") - F.col("p"), F.col("hub_n") - F.col("hub_p"))
        link(live.join(hub, "word").where("root <> hub_root")
             .where(F.greatest("n", "hub_n") * share <= F.least("n", "hub_n") * 100)
             .where(room * (100 + share) >= (F.col("n") + F.col("hub_n")) * share)
             .select(F.least("t", "hub_t").alias("a"), F.greatest("t", "hub_t").alias("b")).distinct())
        groups = live.where("at > cut").drop("cut", "root")
        hubs_wanted *= GROWTH
    named = classes.select(F.col("mark").alias("_mark"), F.col("id").alias("root"))
    for map_ in maps:
        named = _relabel(named, map_)
    named = settle(named, "named")
    return (sketched.select("doc_id", "n", "mark")
            .join(named, (F.col("mark") == F.col("_mark")) & F.col("doc_id").isNotNull(), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row of each group of near-duplicates; of rows with equal id and text, one. Columns stay."""
    sig, row = free_name(docs, "_sig"), free_name(docs, "_d")
    gone = settle(components(docs, share).where("not kept").select(F.col("doc_id").alias(row)).distinct(), "near-copies")
    left = docs.join(gone, docs["doc_id"] == gone[row], "left_anti")
    return left.withColumn(sig, F.xxhash64(text_or_empty())).dropDuplicates(["doc_id", sig]).drop(sig)


@query()
def op3_near_duplicates(spark, sf_dir):
    return components(table(spark, sf_dir, "documents"))
