import random

import numpy as np
import pyarrow.parquet as pq

from tierblend.llm import toxicity as tox

SCHEMA = "doc_id long, text string, score string, evidence string, label string"


def test_neighbours_are_exact():
    rng = random.Random(2)
    words = [f"word{chr(97 + i)}" for i in range(20)]
    bags, labels = [], []
    for i in range(400):
        y = int(rng.random() < 0.3)
        labels.append(y)
        bags.append({w: rng.randint(1, 4) for w in rng.sample(words[:8] if y and rng.random() < .9 else words[6:], 4)})
    index = tox.Index(list(range(400)), bags, np.array(labels))
    assert index.vocab
    dense = np.zeros((400, len(index.vocab)))
    for i, b in enumerate(bags):
        at, w = index.vector(b)
        dense[i, at] = w
    for i in range(0, 400, 7):
        sims = dense @ dense[i]
        want = sorted(((-round(s, 9), j) for j, s in enumerate(sims) if s > 0))[:tox.NEIGHBOURS]
        got = index.nearest(bags[i])
        assert np.allclose([-a for a, _ in want], [s for s, _ in got])


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in tox.op6_toxicity(spark, sf).collect()}
    truth = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    pairs = [(rows[d].predicted, y) for d, y in zip(truth["doc_id"], truth["toxic"]) if rows[d].held_out]
    assert np.mean([a == b for a, b in pairs]) >= 0.93


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "", "", ""), (None, "", "", "", ""), (1, "idiot " * 100_000, "", "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tox.scored(df, tox.build(df, none)).collect()] == [0.0] * 3
    assert tox.scored(df.where("false"), tox.build(df, none)).count() == 0


def test_every_example_is_indexed_at_any_share():
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(20)]
    for share in (0.02, 0.34, 0.9):
        labels = np.array([int(rng.random() < share) for _ in range(300)])
        bags = [{w: rng.randint(1, 3) for w in rng.sample(words, 12)} for _ in labels]
        index = tox.Index(list(range(300)), bags, labels)
        assert set(index.vocab) == {w for b in bags for w in b}
        dense = np.zeros((300, len(index.vocab)))
        for i, b in enumerate(bags):
            at, w = index.vector(b)
            dense[i, at] = w
        for i, b in enumerate(bags):
            want = sorted((-round(s, 9), j) for j, s in enumerate(dense @ dense[i]) if s > 0)[:tox.NEIGHBOURS]
            got = index.nearest(b)
            assert got[0][1] == i and np.allclose([-s for s, _ in want], [s for s, _ in got])
            assert index.score(b)[1]


def test_vectors_of_texts_equal_those_of_bags():
    rng = random.Random(5)
    words = [a + b + c for a in ("", "under", "overs", "été") for b in ("take", "stand", "go") for c in ("", "n", "ing", "ings")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["", "1 2", "Nowhere", "a_b Over's"]
    index = tox.Index(list(range(200)), [tox.terms(t) for t in texts[:200]], np.array([i % 3 == 0 for i in range(200)]))
    for t in texts * 2:
        at, weight = index.text_vector(t)
        want_at, want = index.vector(tox.terms(t))
        assert np.array_equal(at, want_at) and np.allclose(weight, want, rtol=1e-14, atol=0)


def test_only_ties_are_summed_again():
    """Sums of all terms are cosines already; only those too close to another to tell apart are taken anew."""
    rng = random.Random(6)
    bags = [{f"w{rng.randrange(60)}": rng.randint(1, 3) for _ in range(8)} for _ in range(150)]
    bags += bags[:20]
    index = tox.Index(list(range(170)), bags, np.array([i % 2 for i in range(170)]))
    asked, taken = index._exact, []
    index._exact = lambda wanted: taken.append(len(wanted)) or asked(wanted)
    for b in bags[:40]:
        at, w = index.vector(b)
        dense = np.zeros(len(index.vocab))
        dense[at] = w
        sims = np.zeros(170)
        for i, own in enumerate(bags):
            other_at, other = index.vector(own)
            sims[i] = dense[other_at] @ other
        got = index.nearest(b)
        want = sorted((-round(s, 12), j) for j, s in enumerate(sims) if s > 0)[:tox.NEIGHBOURS]
        assert np.allclose([s for s, _ in got], [-s for s, _ in want], atol=1e-11)
        exact = {j: s for j, s in enumerate(sims)}
        assert all(a > b - 1e-9 for a, b in zip([exact[j] for _, j in got], [exact[j] for _, j in got][1:]))
    assert sum(taken) < 40 * tox.NEIGHBOURS
