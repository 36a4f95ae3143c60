"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Null texts count as empty; empty texts give no ids. Every input row gives one output row, so repeated rows and
repeated ids are kept. Extra columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain
from operator import itemgetter

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from tierblend.llm.base import query, table, text_or_empty
from tierblend.session import ship_by_value

ship_by_value(__name__)

#: Pre-tokens of up to so many characters are remembered; beyond so many of them a Python worker starts anew.
CACHE_CHARS, CACHE_ENTRIES = 64, 1_000_000
#: Characters of texts whose new pre-tokens go through one queue.
QUEUE_CHARS = 1 << 18


class RankQueue:
    """Positions by merge rank: a bucket per rank, and a bitmap of three levels that tells which buckets hold any.

    Each word of a level covers 64 entries of the level below; find-first-set walks down from the top.
    """

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(position)
            return
        self.buckets[rank] = [position]
        word, group = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[group] = self.mid.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def pop_rank(self):
        """The smallest rank and its positions, or None."""
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        bits = self.mid[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.low[word] = bits & bits - 1
        if not self.low[word]:
            self.mid[group] &= ~(1 << (word & 63))
            if not self.mid[group]:
                self.top &= ~(1 << group)
        return rank, self.buckets.pop(rank)


def merge_pieces(pieces: list[bytes], ranks: dict[bytes, int], pairs: list[int]) -> list[tuple]:
    """Ids of many pre-tokens over one queue: each is a linked list of its own, so they never merge with each other.

    The lowest rank of all merges first, from left to right; within a pre-token that is its own order.
    """
    data = b"".join(pieces)
    n = len(data)
    parts = [data[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_at = [-1] * n  # rank of the pair that starts here now; other queue entries are stale
    queue = RankQueue()
    buckets, push, pop, get = queue.buckets, queue.push, queue.pop_rank, ranks.get
    begin = 0
    for piece in pieces:
        end = begin + len(piece)
        before[begin] = after[end - 1] = -1
        i = begin
        for pair in zip(piece, piece[1:]):
            rank = pairs[pair[0] << 8 | pair[1]]
            if rank >= 0:
                rank_at[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    push(rank, i)
            i += 1
        begin = end
    while (found := pop()) is not None:
        rank, places = found
        if len(places) > 1:
            places.sort()
        for i in places:
            if rank_at[i] != rank:
                continue
            j = after[i]
            parts[i] = whole = parts[i] + parts[j]
            rank_at[j] = -1
            after[i] = j = after[j]
            if j >= 0:
                before[j] = i
                rank_at[i] = fresh = get(whole + parts[j], -1)
                if fresh >= 0:
                    if fresh in buckets:
                        buckets[fresh].append(i)
                    else:
                        push(fresh, i)
            else:
                rank_at[i] = -1
            j = before[i]
            if j >= 0:
                rank_at[j] = fresh = get(parts[j] + whole, -1)
                if fresh >= 0:
                    if fresh in buckets:
                        buckets[fresh].append(j)
                    else:
                        push(fresh, j)
    out, begin = [], 0
    for piece in pieces:
        ids, i = [], begin
        while i >= 0:
            ids.append(ranks[parts[i]])
            i = after[i]
        out.append(tuple(ids))  # the collector need not follow tuples of numbers
        begin += len(piece)
    return out


def _picked(items: list, places):
    """``items`` at ``places``; one call for all of them."""
    return itemgetter(*places)(items) if len(places) > 1 else [items[i] for i in places]


class Codec:
    def __init__(self, blob: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
        self.pieces: list = [None] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.names = [str(i) for i in range(len(self.pieces))]
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, tuple] = {}

    def learn(self, words) -> None:
        """Ids of all these pre-tokens, into ``cache``; those in the vocabulary whole need no merge."""
        fresh, raws = [], []
        for word in words:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[word] = (whole,)
            else:
                fresh.append(word)
                raws.append(raw)
        self.cache.update(zip(fresh, merge_pieces(raws, self.ranks, self.pairs)))

    def encode_many(self, texts) -> list[list[int]]:
        """Ids of each text; new pre-tokens of a run of texts share one queue, of some ``QUEUE_CHARS`` or one text."""
        out, run, size = [], [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= QUEUE_CHARS:
                out += self._run(run)
                run, size = [], 0
        return out + self._run(run)

    def _run(self, texts) -> list[list[int]]:
        cache, out, long = self.cache, [], set()
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        split = [self.split(t) for t in texts]
        seen = set().union(*split)
        new = seen.difference(cache)
        if new:
            self.learn(new)
            long = {w for w in new if len(w) > CACHE_CHARS}
        for words in split:
            out.append(list(chain.from_iterable(map(cache.__getitem__, words))))
        for w in long:
            del cache[w]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(_picked(self.pieces, ids))

    def written(self, ids) -> str:
        """Decimal ids joined by commas."""
        return ",".join(_picked(self.names, ids))


_codecs: dict = {}


def codec(shared, pattern: str) -> Codec:
    key = (hash(shared.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def vocabulary(spark, path: str):
    """The rank file, read once by the driver and sent to each executor; its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``ids`` (replacing a column of that name)."""
    shared = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = codec(shared, pattern)
        return pd.Series(own.encode_many(texts), index=texts.index, dtype=object)

    return docs.withColumn("ids", ids(text_or_empty(text)))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded`` (binary). Null ids give empty bytes."""
    shared = vocabulary(encoded.sparkSession, path)

    @F.pandas_udf("binary")
    def back(rows: pd.Series) -> pd.Series:
        own = codec(shared, "")
        if any(len(ids) and min(ids) < 0 for ids in rows):
            raise ValueError("ids are at least 0")
        return rows.map(own.decode)

    return encoded.withColumn("decoded", back(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in the same task, only digests leave it."""
    shared = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        own = codec(shared, pattern)
        rows = []
        for at in range(0, len(texts), 64):
            for ids in own.encode_many(texts.iloc[at:at + 64]):
                rows.append((len(ids), hashlib.sha256(own.written(ids).encode()).hexdigest(),
                             hashlib.sha256(own.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(text_or_empty()).alias("d")).select("doc_id", "d.*")


def multilingual() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query()
def op7_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), *multilingual())
