import numpy as np
import pytest

from tierblend.operators import hashed_neighbours as hashed

ROWS = "ID bigint, v array<double>, tab string, vec int"


def _table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r], "clash", 0) for i, r in enumerate(x)], ROWS)


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["neighbour"], r["distance"]))
    return out


def _brute(q, t, k):
    d = np.sqrt(((q[:, None, :] - t[None, :, :]) ** 2).sum(axis=2))
    return {i: sorted(range(len(t)), key=lambda j: (d[i, j], j))[:k] for i in range(len(q))}, d


def _recall(got, want):
    """Share of true neighbours found, the row itself (always found) left out."""
    hits = [j in {n for n, _ in got.get(i, [])} for i, js in want.items() for j in js if j != i]
    return sum(hits) / len(hits)


def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id")
    x = np.array([r["embedding"] for r in df.collect()], dtype=np.float64)
    want, d = _brute(x[:300], x, 9)
    table = _table(spark, x)
    index = hashed.fit_tables(table, table, 9, vector="v", bits=4)
    assert index.bits == 4 and index.recall >= 0.95
    got = _got(hashed.nearest_hashed(table, table, 9, vector="v", index=index))
    assert len(got) == len(x)
    assert _recall({i: got[i] for i in range(300)}, want) >= 0.9
    assert all(dist == pytest.approx(d[i, j], abs=1e-12) for i in range(300) for j, dist in got[i])


def test_near_neighbours_need_few_visits(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 1, 16)) + 0.05 * rng.normal(size=(400, 5, 16))).reshape(-1, 16)
    table = _table(spark, x)
    index = hashed.fit_tables(table, table, 4, vector="v")
    # a small part of the rows is looked at
    assert index.tables * index.visits * 2.0**-index.bits < 0.1
    want, _ = _brute(x, x, 5)
    assert _recall(_got(hashed.nearest_hashed(table, table, 5, vector="v", index=index)), want) >= 0.9


def test_slices_change_nothing(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(200, 4))
    table = _table(spark, x)
    index = hashed.fit_tables(table, table, 3, vector="v")
    whole = _got(hashed.nearest_hashed(table, table, 3, vector="v", index=index))
    monkeypatch.setattr(hashed, "SLICE_ROWS", 7)
    assert _got(hashed.nearest_hashed(table, table, 3, vector="v", index=index)) == whole


def test_copies_ties_and_signed_zero(spark):
    x = np.concatenate([np.zeros((60, 3)), [[1.0, 0, 0], [0, 1.0, 0], [0, 0, -1.0]]])
    x[1] *= -1.0  # -0.0 is the same value
    q = np.concatenate([np.zeros((20, 3)), [[2.0, 0, 0]]])
    got = _got(hashed.nearest_hashed(_table(spark, q), _table(spark, x), 5, vector="v"))
    assert all([n for n, _ in got[i]] == [0, 1, 2, 3, 4] for i in range(20))
    assert got[20] == [(60, 1.0), (0, 2.0), (1, 2.0), (2, 2.0), (3, 2.0)]


def test_nulls_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 3.0])], "ID bigint, v array<double>")
    got = _got(hashed.nearest_hashed(df, df, 5, vector="v"))
    assert got == {1: [(1, 0.0), (3, 2.0)], 3: [(3, 0.0), (1, 2.0)]}
    none = df.filter("ID < 0")
    assert hashed.nearest_hashed(df, none, 5, vector="v").isEmpty()
    assert hashed.nearest_hashed(none, df, 5, vector="v").isEmpty()


def test_visits_start_at_the_own_code_and_follow_the_price():
    sides = np.array([[[0.5, -0.1, 2.0]]])
    assert hashed._visited(sides, 4).tolist() == [[[5, 7, 4, 6]]]
    near = np.array([[[-0.5, -0.1, 2.0], [0.5, 0.1, 2.0], [0.5, -0.1, -2.0]]])
    assert hashed._visits_needed(sides, near, np.array([0, 0, 0])).tolist() == [[3, 2, 5]]
