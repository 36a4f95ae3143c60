"""What the neighbour joins send: a query per hall, not per chunk; vectors as short as they came, and never stored by bucket."""

import numpy as np

from tierblend.operators import hashed_neighbours as hashed
from tierblend.operators import neighbours


def _table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], i % 5) for i, r in enumerate(x)], "ID bigint, v array<float>, fold int")


def _brute(x, k, apart):
    x = x.astype(np.float32).astype(float)
    out = {}
    for i, a in enumerate(x):
        d = np.sqrt(((x - a) ** 2).sum(axis=1))
        out[i] = sorted((j for j in range(len(x)) if not apart or j % 5 != i % 5), key=lambda j: (d[j], j))[:k]
    return out


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append(r["neighbour"])
    return out


def test_a_query_is_sent_once_per_hall(spark, monkeypatch):
    x, sent, routed = np.random.default_rng(1).normal(size=(400, 8)), [], neighbours._routed
    monkeypatch.setattr(neighbours, "GRID_ROWS", 40, raising=False)
    monkeypatch.setattr(neighbours, "_routed", lambda *a, **kw: sent.append(routed(*a, **kw)) or sent[-1])
    table = _table(spark, x)
    got = _got(neighbours.nearest(table, table, 4, vector="v", apart="fold", chunk_rows=20))
    assert got == _brute(x, 4, True)
    # nothing can be pruned here, and there are about a hundred chunks
    busy = int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))
    assert sent[0].count() <= 400 * busy
    assert sent[0].schema["qvec"].dataType.simpleString() == "array<float>"


def test_halls_hold_about_equal_rows():
    pivots = np.arange(12.0)[:, None] % 4
    cells = neighbours._Cells({(0, c): 10 + c for c in range(12)}, {(0, c): 1.0 for c in range(12)})
    hall_of = neighbours._halls(cells, neighbours._chunk_layout(cells, 8), pivots, 3)
    rows = np.bincount(hall_of, weights=np.concatenate([[(10 + c) / m] * m for c in range(12) for m in [-(-(10 + c) // 8)]]))
    assert len(rows) == 3 and rows.max() <= 1.3 * rows.min()


def test_hashed_vectors_are_not_stored_by_bucket(spark, monkeypatch):
    x, stored, settle = np.random.default_rng(2).normal(size=(300, 6)), [], hashed.settle
    monkeypatch.setattr(hashed, "settle", lambda df, name, *a: stored.append(df.schema) or settle(df, name, *a))
    table = _table(spark, x)
    got, want = _got(hashed.nearest_hashed(table, table, 4, vector="v", bits=2)), _brute(x, 4, False)
    assert np.mean([len(set(got[i]) & set(want[i])) / 4 for i in want]) >= 0.9
    assert not any({"vec", "code"} <= set(s.names) for s in stored)
    assert {s["vec"].dataType.simpleString() for s in stored if "vec" in s.names} == {"array<float>"}


def test_slices_follow_the_length_of_vectors(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(120, 6))
    table = _table(spark, x)
    whole = _got(hashed.nearest_hashed(table, table, 3, vector="v", bits=1))
    monkeypatch.setattr(hashed, "SLICE_BYTES", 8 * 6 * 11, raising=False)
    assert _got(hashed.nearest_hashed(table, table, 3, vector="v", bits=1)) == whole
