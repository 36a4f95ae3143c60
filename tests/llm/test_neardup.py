import random
import re

import pytest

import corpus_pipeline
from tierblend.llm import neardup

SCHEMA = "doc_id long, text string, n string, mark string, root string, id string"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[x + 1:]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                r, s = sorted((find(a), find(b)))
                root[s] = r
    return {i: (len(sets[i]), find(i)) for i in keys}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "one two", "ONE two", "one\x1ctwo"]
    for n in (6, 20, 60, 300):
        base = [word() for _ in range(n)]
        chain = list(base)
        for k in range(12):
            texts.append(" ".join(chain))
            if k % 3 == 0:
                texts.append(" ".join(base))
            chain = chain[1:] + [word()] if n < 60 else chain[:rng.randrange(n)] + [word()] + chain[rng.randrange(n):] if k % 5 == 4 else chain[:n - 1] + [word()]
            mid = rng.randrange(len(base))
            texts.append(" ".join(base[:mid] + [word()] + base[mid + 1:]))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_components_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, "c", "c", "c", "c") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(df).collect()}
    assert got == brute(rows)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len({c for _, c in got.values()})


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b", "", "", "", "")] * 2 + [(4, "a b", "", "", "", "")] * 2, SCHEMA)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.components(df).collect()) == [
        (0, 0, True), (0, 0, True), (4, 4, True), (4, 4, True)]
    assert neardup.components(df.where("false")).count() == 0


def test_pipeline_drops_copies_from_80_percent_on(spark):
    words = [f"w{i}" for i in range(400)]
    text = lambda a, b: " ".join(words[a:b])
    pairs = [(text(0, 8), text(0, 9)), (text(10, 114), text(10, 136)), (text(150, 193), text(150, 200)),  # 0.80, 0.82, 0.85-
             (text(210, 217), text(210, 218))]  # 3 of 4 shingles: below
    rows = [(2 * i + k, t, "", "", "", "") for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, None).collect()) == [0, 2, 4, 6, 7]
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == list(range(8))


def test_crowded_buckets_equal_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(260):  # no text without changes: most pairs share buckets and stay below the threshold
        words = list(base)
        for at in rng.sample(range(90), rng.randrange(1, 5)):
            words[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(df).collect()}
    assert got == brute(rows)
