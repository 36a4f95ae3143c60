"""License scans: a trained paragraph classifier, a calibrated unknown class, and template comparison.

Paragraphs are the non-empty lines of a text and, for notices that are wrapped, the shortest runs of consecutive lines
that hold a template; comment marks are no words, and a line without words ends a run. ``n_paragraphs`` counts the
lines; evidence names a line or the first and last line of a run. A sparse logistic regression per family over hashed word 1- to 3-grams is
trained here, by numpy, on the templates with words dropped or added against paragraphs of the corpus (at most
``SAMPLE`` of them, those with the smallest hash, that share no template trigram). The unknown class is calibrated on
held-back paragraphs: the score that all but ``FALSE_SHARE`` of them stay below, and at least one half. A prediction is
confirmed when enough template words occur in order-free comparison, and in the other direction when the paragraph has
the words that tell the family from its neighbours (``TELLING``). Null and empty texts have no paragraphs and no
license; repeated rows get equal results; ties between families go to the first; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tierblend.llm.base import query, table, text_or_empty
from tierblend.session import ship_by_value

ship_by_value(__name__)

# Short notices of license families.
TEMPLATES = {
    "Apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", "Released under the BSD 3-Clause License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a "
            "copy of this software and associated documentation files"],
}
#: What a family's notices say and those of its neighbours do not (Lesser and Affero GPL, share-alike and so on), over
#: words joined by blanks.
TELLING = {
    "Apache": r"\bapache license\b",
    "BSD": r"\bbsd\b|\bredistribution and use in source and binary forms\b",
    "CC-BY-NC": r"\bby nc\b(?! (sa|nd)\b)|\battribution non ?commercial\b(?! (share ?alike|no ?deriv))",
    "CC-BY": r"\bcc by\b(?! (nc|sa|nd)\b)|\bcommons attribution\b(?! (non ?commercial|share ?alike|no ?deriv))",
    "GPL": r"(?<!lesser )(?<!library )(?<!affero )\bgeneral public license\b",
    "MIT": r"\bmit license\b|\bto any person obtaining a copy\b",
}
FAMILIES = sorted(TEMPLATES)
BUCKETS, SAMPLE, FALSE_SHARE, CONFIRM, COPIES, EPOCHS, SEED = 1 << 14, 4_000, 0.001, 0.7, 40, 6, 3
_WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")


def _words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def features(words: list[str]) -> np.ndarray:
    grams = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return np.unique([zlib.crc32(g.encode()) % BUCKETS for g in grams]) if grams else np.zeros(0, np.int64)


class Model:
    def __init__(self, background: list[tuple[np.ndarray, list[str]]]):
        """From features and first words of paragraphs outside the templates."""
        rng = np.random.default_rng(SEED)
        self.known = {w for ts in TEMPLATES.values() for t in ts for w in _words(t)}
        self.templates = [(k, set(_words(t))) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
        self.longest = 2 * max(len(_words(t)) for ts in TEMPLATES.values() for t in ts)
        fit, held = background[::2], background[1::2]
        rows = [(at, -1) for at, _ in fit]
        filler = [x for _, w in fit[:200] for x in w] or ["word"]
        for k, f in enumerate(FAMILIES):
            for t in TEMPLATES[f]:
                for c in range(COPIES):
                    ws = [w for w in _words(t) if c == 0 or rng.random() > 0.08]
                    extra = [filler[i] for i in rng.integers(0, len(filler), c % 4)]
                    rows.append((features(extra + ws), k))
        self.weights, self.shift = np.zeros((BUCKETS, len(FAMILIES))), np.full(len(FAMILIES), -2.0)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                at, y = rows[i]
                if not len(at):
                    continue
                p = 1 / (1 + np.exp(-np.clip(self.weights[at].sum(0) / np.sqrt(len(at)) + self.shift, -30, 30)))
                if y >= 0:
                    p[y] -= 1
                self.weights[at] -= p / np.sqrt(len(at))
                self.shift -= 0.05 * p
        scores = [self.score(at).max() for at, _ in held]
        self.least = max(0.5, float(np.quantile(scores, 1 - FALSE_SHARE))) if scores else 0.5

    def score(self, at: np.ndarray) -> np.ndarray:
        z = self.weights[at].sum(0) / np.sqrt(max(1, len(at))) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def judge(self, words: list[str]):
        """(confirmed, score, family), or none below the threshold."""
        p = self.score(features(words))
        k = int(p.argmax())
        if p[k] < self.least:
            return None
        return self.holds(k, words), float(p[k]), FAMILIES[k]

    def holds(self, family: int, words: list[str]) -> bool:
        own = set(words)
        return (any(f == family and len(own & t) >= CONFIRM * len(t) for f, t in self.templates)
                and re.search(TELLING[FAMILIES[family]], " ".join(words)) is not None)

    def wrapped(self, run: list[tuple]):
        """The shortest confirmed paragraph of two lines or more at the end of ``run``, with its first line's place."""
        seen, total = set(run[-1][2]), len(run[-1][1])
        for i in range(len(run) - 2, -1, -1):
            more = run[i][2] - seen
            seen |= more
            total += len(run[i][1])
            if more and any(len(seen & t) >= CONFIRM * len(t) for _, t in self.templates):
                found = self.judge([w for _, words, _ in run[i:] for w in words])
                if found is not None and found[0]:
                    return *found, i
            if total > self.longest:
                break
        return None

    def classify(self, text: str):
        """paragraphs, family (null: none), score, confirmed, and the lines of confirmed predictions as evidence."""
        count, best, lines, run = 0, (False, 0.0, None), [], []
        for n, paragraph in enumerate(text.split("\n")):
            words = _words(paragraph) if paragraph.strip() else []
            count += bool(paragraph.strip())
            sure = False
            # two template words at least, or no template can be confirmed
            if len(self.known.intersection(words)) >= 2:
                found = self.judge(words)
                sure = found is not None and found[0]
                if sure:
                    lines.append(f"{n}:{found[2]}")
                if found is not None and found[:2] > best[:2]:
                    best = found
            if sure or not words:
                run = []
                continue
            run.append((n, words, self.known.intersection(words)))
            found = self.wrapped(run)
            if found is not None:
                lines.append(f"{run[found[3]][0]}-{n}:{found[2]}")
                if found[:2] > best[:2]:
                    best = found[:3]
                run = []
        return count, best[2], best[1], best[0], ",".join(lines)


def _trigrams(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:]))


def background(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[np.ndarray, list[str]]]:
    """Features and first words of at most ``sample`` distinct paragraphs with words and without a template's trigram."""
    templates = {g for ts in TEMPLATES.values() for t in ts for g in _trigrams(_words(t))}

    @F.pandas_udf("boolean")
    def other(paragraphs: pd.Series) -> pd.Series:
        found = (_words(p) for p in paragraphs)
        return pd.Series([bool(w) and templates.isdisjoint(_trigrams(w)) for w in found], dtype=bool)

    @F.pandas_udf("ids binary, first array<string>")
    def pack(paragraphs: pd.Series) -> pd.DataFrame:
        found = [_words(p) for p in paragraphs]
        return pd.DataFrame({"ids": [features(w).astype(np.int32).tobytes() for w in found], "first": [w[:20] for w in found]})

    lines = (docs.select(F.explode(F.split(text_or_empty(), "\n")).alias("p")).where(F.trim("p") != "")
             .select(F.xxhash64("p").alias("h"), "p"))
    distinct = lines.agg(F.approx_count_distinct("h")).first()[0]
    # only lines below a cut of the hash are shuffled; the cut rises until it leaves enough of them or none out
    share = min(1.0, 4 * sample / max(1, distinct))
    while True:
        below = lines if share >= 1 else lines.where(F.col("h") < F.lit(int(share * 2.0**64) - 2**63))
        rows = (below.distinct().where(other("p")).orderBy("h", "p").limit(sample)
                .select("h", pack("p").alias("s")).select("h", "s.*").collect())
        if len(rows) >= sample or share >= 1:
            break
        share = min(1.0, 8 * share)
    rows.sort(key=lambda r: (r["h"], r["first"]))
    return [(np.frombuffer(r["ids"], np.int32), list(r["first"])) for r in rows]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    return Model(background(docs, sample))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, family, score, confirmed, evidence per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights per family

    def run(texts):
        names = ["n_paragraphs", "family", "score", "confirmed", "evidence"]
        return pd.DataFrame([shared.value.classify(t) for t in texts], columns=names)

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(run, "n_paragraphs long, family string, score double, confirmed boolean, evidence string")
    return docs.select("doc_id", udf(text_or_empty()).alias("s")).select("doc_id", "s.*")


@query()
def op4_licenses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))
