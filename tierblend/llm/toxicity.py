"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

The index holds at most ``SAMPLE`` labelled documents (smallest hash of their id), the one bound here, each with all
its terms. A term weighs its inverse document frequency times ``PLAIN`` and how far it speaks for label 1: the
logarithm of its odds, at the lower end of the estimate, against those of all examples, 0 if below. No term is left
out, and only odds against odds count, so the weights hold at any share of label 1. A text adds up its very frequent
terms (a matrix product for a batch of texts), its rare ones and the heaviest of those between; the others are bounded
by their largest weight per block of ``BLOCK`` examples, and are added too where more than ``FEW`` examples can still reach the k-th neighbour. Those that can are compared on all
terms, so the neighbours are exact. Votes are weighted by cosine; a piecewise-constant monotone fit on the examples themselves, each
left out of its own vote, calibrates them. Evidence is the neighbours' ids.

Null and empty texts and those without a known term have no neighbours and score the share of label 1 among examples
that have none either, or among all examples when each has one. Ties in cosine go to the smaller id. Repeated rows
score alike; without labels all score 0. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tierblend.llm.base import query, table, text_or_empty
from tierblend.llm.quality import held_out, learn_rows
from tierblend.session import ship_by_value

ship_by_value(__name__)

SAMPLE, NEIGHBOURS, BLOCK, PLAIN, THRESHOLD = 6_000, 15, 64, 0.1, 0.7
#: Frequent terms added up at first, examples that are few enough to be compared on all terms, and the part of the
#: examples (one in so many) from which on a term's weights are stored for every example.
FIRST, FEW, WIDE = 256, 150, 16
#: Texts whose widely stored terms are added up in one matrix product.
BATCH = 64
#: Longer words also count under their first STEM letters, and such a stem again when a text has it OFTEN times.
STEM, OFTEN = 5, 3
#: Words whose terms a task keeps at hand.
KEPT = 1 << 16
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> dict[str, int]:
    words = Counter(_WORD.findall(text.lower()))
    stems: dict[str, int] = {}
    for w, c in words.items():
        if len(w) > STEM:
            stem = w[:STEM] + "*"
            stems[stem] = stems.get(stem, 0) + c
    return {**words, **stems, **{w + "+": c for w, c in stems.items() if c >= OFTEN}}


def _ranges(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the slices ``at`` of an array cut at ``starts``, and the length of each slice."""
    lengths = starts[at + 1] - starts[at]
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts[at] - before, lengths) + np.arange(lengths.sum()), lengths


class _Known(dict):
    """By word: its term and its stem's number, each plus one (0 if the index has none), packed into one number."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        names = sorted({w[:STEM] for w in vocab if w[STEM:] in ("*", "*+")})
        self.vocab, self.stems = vocab, {w: i for i, w in enumerate(names, 1)}
        self.star = np.array([vocab.get(w + "*", -1) for w in names], np.int64)
        self.plus = np.array([vocab.get(w + "*+", -1) for w in names], np.int64)

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        packed = (self.vocab.get(word, -1) + 1) << 32 | (self.stems.get(word[:STEM], 0) if len(word) > STEM else 0)
        self[word] = packed
        return packed


class Index:
    def __init__(self, ids: list[int], bags: Iterable[dict[str, int]], labels: np.ndarray):
        self.ids, self.labels, n = np.asarray(ids, dtype=np.int64), labels.astype(float), len(ids)
        place: dict[str, int] = {}
        own, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for bag in bags:
            own.append(np.fromiter((place.setdefault(w, len(place)) for w in bag), np.int32, len(bag)))
            counts.append(np.fromiter(bag.values(), np.int64, len(bag)))
        self.vocab = {w: t for t, w in enumerate(sorted(place))}
        rank = np.zeros(len(place), np.int32)
        rank[np.fromiter((place[w] for w in self.vocab), np.int64, len(place))] = np.arange(len(place))
        rows, cols = np.repeat(np.arange(n, dtype=np.int32), [len(a) for a in own[1:]]), rank[np.concatenate(own)]
        order = np.lexsort((cols, rows))
        self.own_terms, counts = cols[order], np.concatenate(counts)[order]
        self.counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
        self.own_starts = np.searchsorted(rows, np.arange(n + 1))
        del place, own, rank, rows, cols, order, counts  # not held beside what follows
        self._arrange()
        mine = [slice(a, b) for a, b in zip(self.own_starts, self.own_starts[1:])]
        own_vectors = [(self.own_terms[m], self.own_weights[m]) for m in mine]
        raw = np.array([self._vote(found) for found in self._searched(own_vectors, NEIGHBOURS, range(n))], dtype=float)
        known = ~np.isnan(raw)
        self.bare = float((self.labels if known.all() else self.labels[~known]).mean()) if n else 0.0
        self.steps, self.values = np.zeros(0), np.zeros(0)
        self._calibrate(raw[known], self.labels[known])

    def _arrange(self) -> None:
        """Weights, by example, by term, and the largest by term and block: all that follows from terms and counts."""
        n, cols = len(self.ids), self.own_terms
        rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.own_starts))
        seen = np.bincount(cols, minlength=len(self.vocab))
        self.idf = self._weigh(seen, np.bincount(cols, weights=self.labels[rows], minlength=len(self.vocab)))
        values = (1 + np.log(self.counts.astype(float))) * self.idf[cols]
        values /= np.sqrt(np.bincount(rows, weights=values * values, minlength=n))[rows]
        self.own_weights = values
        order = np.argsort(cols, kind="stable")
        self.docs, self.weights, cols = rows[order], values[order], cols[order]
        self.starts = np.searchsorted(cols, np.arange(len(self.vocab) + 1))
        self.blocks = -(-n // BLOCK)
        key = cols.astype(np.int64) * max(1, self.blocks) + self.docs // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_at = (self.docs[first] // BLOCK).astype(np.int32)
        self.block_top = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.block_starts = np.searchsorted(cols[first], np.arange(len(self.vocab) + 1))
        self.top = np.maximum.reduceat(self.weights, self.starts[:-1]) if len(self.vocab) else np.zeros(0)
        wide = np.flatnonzero(seen * WIDE > n)  # stored for every example: adding whole rows is quicker
        self.dense_at, self.dense = np.full(len(self.vocab), -1, np.int32), np.zeros((len(wide), n))
        self.dense_at[wide] = np.arange(len(wide))
        held = self.dense_at[cols] >= 0
        self.dense[self.dense_at[cols[held]], self.docs[held]] = self.weights[held]
        self.spread = np.zeros(len(self.vocab))
        self.known: _Known | None = None

    def __getstate__(self):
        """What the rest follows from: a broadcast of all arrays would lie on each executor's disk."""
        return ("\n".join(self.vocab), self.ids, self.labels, self.own_terms, self.own_starts, self.counts, self.bare,
                self.steps, self.values)

    def __setstate__(self, state):
        (words, self.ids, self.labels, self.own_terms, self.own_starts, self.counts, self.bare, self.steps,
         self.values) = state
        self.vocab = {w: t for t, w in enumerate(words.split("\n") if words else [])}
        self._arrange()

    def _weigh(self, df: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Weight per term; label 1 among its documents by the lower end of a Wilson interval."""
        n, share = len(self.ids), float(self.labels.mean()) if len(self.ids) else 0.0
        idf = np.log((1 + n) / (1 + df)) + 1
        if not 0 < share < 1:
            return idf * PLAIN
        p, z = hit / df, 2.0
        low = (p + z * z / (2 * df) - z * np.sqrt(p * (1 - p) / df + z * z / (4 * df * df))) / (1 + z * z / df)
        low = np.maximum(low, 1e-12)
        return idf * (PLAIN + np.maximum(0, np.log(low / (1 - low)) - np.log(share / (1 - share))))

    def vector(self, bag: dict[str, int]):
        at = np.fromiter(map(self.vocab.get, bag, repeat(-1)), np.int64, len(bag))
        order = np.argsort(at)[np.count_nonzero(at < 0):]
        if not len(order):
            return np.zeros(0, np.int64), np.zeros(0)
        return self._weighted(at[order], np.fromiter(bag.values(), float, len(bag))[order])

    def _weighted(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(counts)) * self.idf[at]
        return at, weight / np.sqrt(weight @ weight)

    def text_vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``vector(terms(text))`` without a bag: stems are added up as numbers."""
        if self.known is None:  # in tasks only: the driver has no use for it
            self.known = _Known(self.vocab)
        words = Counter(_WORD.findall(text.lower()))
        packed = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        counts = np.fromiter(words.values(), float, len(words))
        own, stem = (packed >> 32) - 1, (packed & 0xFFFFFFFF) - 1
        order = np.argsort(stem)[np.count_nonzero(stem < 0):]
        stem, sums = stem[order], counts[order]
        if len(order):
            first = np.flatnonzero(np.diff(stem, prepend=-1))
            stem, sums = stem[first], np.add.reduceat(sums, first)
        often = sums >= OFTEN
        at = np.concatenate([own, self.known.star[stem], self.known.plus[stem[often]]])
        order = np.argsort(at)[np.count_nonzero(at < 0):]
        if not len(order):
            return np.zeros(0, np.int64), np.zeros(0)
        return self._weighted(at[order], np.concatenate([counts, sums, sums[often]])[order])

    def nearest(self, bag: dict[str, int], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, as (cosine, position); exact."""
        return next(self._searched([self.vector(bag)], k))

    def _searched(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]], k: int, leave: Sequence[int] | None = None):
        """The neighbours of every vector in turn; example ``leave[i]`` is no neighbour of vector i."""
        for start in range(0, len(vectors), BATCH):
            part = vectors[start:start + BATCH]
            wide = np.zeros((len(part), len(self.dense)))
            for row, (at, weight) in zip(wide, part):
                held = self.dense_at[at]
                row[held[held >= 0]] = weight[held >= 0]
            for i, (sums, (at, weight)) in enumerate(zip(wide @ self.dense, part), start):
                yield self._search(at, weight, k, -1 if leave is None else leave[i], sums)

    def _search(self, at: np.ndarray, weight: np.ndarray, k: int, leave: int, sums: np.ndarray) -> list[tuple[float, int]]:
        """``sums`` holds the share of widely stored terms in every example's cosine."""
        n = len(self.ids)
        if not len(at):
            return []
        listed = self.dense_at[at] < 0
        turn, part = at[listed], weight[listed]
        frequent = self.starts[turn + 1] - self.starts[turn] > BLOCK
        order = np.lexsort((-part * self.top[turn], frequent))
        turn, part, cut = turn[order], part[order], len(turn) - int(frequent.sum()) + FIRST
        self.spread[at] = weight
        most = sums = self._add(sums, turn[:cut], part[:cut])
        if leave >= 0:
            sums[leave] = -np.inf
        if cut < len(turn):
            found, lengths = _ranges(self.block_starts, turn[cut:])
            rest = np.bincount(self.block_at[found], np.repeat(part[cut:], lengths) * self.block_top[found], self.blocks)
            most = sums + np.repeat(rest, BLOCK)[:n]
            if np.count_nonzero(most >= self._kth(self._exact(self._top(sums, 2 * k)), k) - 1e-9) > FEW:
                most = self._add(sums, turn[cut:], part[cut:])
        least = self._kth(sums if most is sums else self._exact(self._top(sums, 2 * k)), k)
        wanted = np.flatnonzero((most > 0) & (most >= least - 1e-9))
        exact = self._close(wanted, sums[wanted]) if most is sums else self._exact(wanted)
        exact = np.round(exact, 12)
        self.spread[at] = 0
        best = np.lexsort((self.ids[wanted], -exact))[:k]
        return [(float(exact[j]), int(wanted[j])) for j in best if exact[j] > 0]

    def _close(self, wanted: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Cosines that are complete but for the order of summation; those too close to another are taken anew."""
        order = np.argsort(sums)
        near = np.diff(sums[order]) < 1e-9
        tied = order[np.append(near, False) | np.append(False, near)]
        if len(tied):
            sums[tied] = self._exact(wanted[tied])
        return sums

    def _add(self, sums: np.ndarray, terms_: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """``sums`` with the share of some listed terms in every example's cosine added, in place."""
        found, lengths = _ranges(self.starts, terms_)
        sums += np.bincount(self.docs[found], np.repeat(weight, lengths) * self.weights[found], len(sums))
        return sums

    def _exact(self, wanted: np.ndarray) -> np.ndarray:
        """Cosines of some examples with the text in ``spread``, on all terms."""
        found, lengths = _ranges(self.own_starts, wanted)
        return np.bincount(np.repeat(np.arange(len(wanted)), lengths),
                           self.spread[self.own_terms[found]] * self.own_weights[found], len(wanted))

    @staticmethod
    def _top(sums: np.ndarray, k: int) -> np.ndarray:
        some = np.argpartition(sums, -k)[-k:] if len(sums) > k else np.arange(len(sums))
        return some[sums[some] >= 0]

    @staticmethod
    def _kth(values: np.ndarray, k: int) -> float:
        return float(np.partition(values, -k)[-k]) if len(values) >= k else 0.0

    def _vote(self, found: list[tuple[float, int]]) -> float:
        if not found:
            return np.nan
        w = np.array([c for c, _ in found])
        return float(w @ self.labels[[i for _, i in found]] / w.sum())

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # [smallest vote, sum of labels, rows]; neighbours out of order are merged
        for v, t in zip(raw[order], y[order]):
            if pools and pools[-1][0] == v:
                pools[-1][1] += t
                pools[-1][2] += 1
            else:
                pools.append([v, t, 1])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, s, n = pools.pop()
                pools[-1][1] += s
                pools[-1][2] += n
        self.steps = np.array([p[0] for p in pools])
        self.values = np.array([p[1] / p[2] for p in pools])

    def scores(self, bags: Iterable[dict[str, int]]) -> list[tuple[float, list[int]]]:
        """Calibrated score and ids of the neighbours per bag."""
        return self._all_scored([self.vector(b) for b in bags])

    def text_scores(self, texts: Iterable[str]) -> list[tuple[float, list[int]]]:
        return self._all_scored([self.text_vector(t) for t in texts])

    def _all_scored(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        return [self._scored(found) for found in self._searched(vectors, NEIGHBOURS)]

    def score(self, bag: dict[str, int]) -> tuple[float, list[int]]:
        return self.scores([bag])[0]

    def _scored(self, found: list[tuple[float, int]]) -> tuple[float, list[int]]:
        if not found:
            return self.bare, []
        vote, near = self._vote(found), [int(self.ids[i]) for _, i in found]
        if not len(self.steps):
            return vote, near
        return float(self.values[max(0, np.searchsorted(self.steps, vote, side="right") - 1)]), near


def build(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1,
          sample: int = SAMPLE) -> Index:
    @F.pandas_udf("words string, counts binary")  # packed: as maps they take many times the driver's memory
    def pack(texts: pd.Series) -> pd.DataFrame:
        bags = [terms(t) for t in texts]
        return pd.DataFrame({"words": [" ".join(b) for b in bags],
                             "counts": [np.array(list(b.values()), np.int32).tobytes() for b in bags]})

    rows = learn_rows(docs, labels, label, folds, held, False, sample)
    got = (rows.select("_d", "label", pack("text").alias("b")).select("_d", "label", "b.*").toPandas().sort_values("_d")
           if sample else pd.DataFrame(columns=["_d", "label", "words", "counts"]))
    bags = (dict(zip(w.split(), np.frombuffer(c, np.int32))) for w, c in zip(got["words"], got["counts"]))
    return Index(got["_d"].tolist(), bags, got["label"].to_numpy(dtype=np.int64))


def scored(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score and evidence (ids of the neighbours) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def score(texts):
        rows = []
        for at in range(0, len(texts), BATCH):  # the terms of a few texts at a time
            rows += shared.value.text_scores(texts.iloc[at:at + BATCH])
        return pd.DataFrame(rows, columns=["score", "evidence"])

    score.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    run = F.pandas_udf(score, "score double, evidence array<long>")
    return docs.select("doc_id", run(text_or_empty()).alias("s")).select("doc_id", "s.*")


@query()
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, build(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
