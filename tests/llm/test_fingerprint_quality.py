import hashlib
import random

import numpy as np

from tierblend.llm import fingerprint as fp, quality

SCHEMA = "doc_id long, text string, score string, part string, label string"


def test_extension_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(2))
        x, y = fp.Prefix(a), fp.Prefix(b)
        for _ in range(20):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert x.extension(i, y, j) == n


def test_next_documents(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "é\U0001f600"] + ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 900))) for _ in range(60)]
    rows = [(i * 3 % 64, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in fp.compare_with_next(df, range_rows=5).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 2
        edited = t[:len(t) - n] + nxt[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert fp.compare_with_next(df.where("false")).count() == 0
    one = spark.createDataFrame([(7, "abcd", "", "", "")] + [(None, "q", "", "", "")] * 3 + [(7, "abcd", "", "", "")], SCHEMA)
    assert fp.compare_with_next(one).count() == 5
    assert fp.compare_with_next(one.limit(1)).collect()[0].near_next == 1.0


def test_held_out_quality(spark, sf):
    import pyarrow.parquet as pq

    rows = {r.doc_id: r for r in quality.op5_quality(spark, sf).collect()}
    truth = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    pairs = [(rows[d].predicted, q) for d, q in zip(truth["doc_id"], truth["quality"]) if rows[d].held_out]
    assert np.mean([a == b for a, b in pairs]) >= 0.9
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, "s", "p", "l"), (None, "", "s", "p", "l"), (3, "x " * 300_000, "s", "p", "l")] * 2, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    assert [r.score for r in quality.scored(df, quality.train(df, none)).collect()] == [0.5] * 6
    one = spark.createDataFrame([(1, 1, "t"), (None, 0, "t"), (3, None, "t")], "doc_id long, quality int, text string")
    kept = quality.keep_good(df, one)
    assert kept.count() == 6 and kept.columns == df.columns
