"""Search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import ann as A


def brute(rows, k):
    """rows: id to vector of the usable ones."""
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-float(np.cumsum(np.float64(v) * np.float64(w))[-1]), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(spark, rows, k=20, kind="array<float>"):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], f"vec_id long, embedding {kind}, list int").repartition(4)
    out = {}
    for r in A.search(df, F.col("id") % 20 == 0, k=k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_scores_and_order(spark, clustered):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24)) * (3 if clustered else 0)
    rows = [(i, (centres[i % 12] + rng.normal(size=24)).astype(np.float32)) for i in range(3000)]
    expected, got = brute(rows, 20), found(spark, rows)
    hits = sum(len({i for i, _ in expected[q]} & {i for i, _ in got[q]}) for q in expected)
    assert hits / (20 * len(expected)) >= 0.9 and all(len(v) == 20 for v in got.values())
    exact = {(q, i): float(np.cumsum(np.float64(dict(rows)[q]) * np.float64(dict(rows)[i]))[-1]) for q in got for i, _ in got[q]}
    assert all(exact[q, i] == s for q, v in got.items() for i, s in v)
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())


def test_chunks_and_ties_of_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(A, "ROW_CHUNK", 50)
    monkeypatch.setattr(A, "QUERY_CHUNK", 4)
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8).astype(np.float32)
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).astype(np.float32)) for i in range(900)]
    got = found(spark, rows)
    expected = brute(rows, 20)
    own = float(np.cumsum(np.float64(hot) * np.float64(hot))[-1])  # of a query that is the hot vector: all its equals, smaller ids first
    assert [i for i, s in got[0] if s == own] == [i for i in range(3, 900, 3)][: 20 - sum(s > own for _, s in got[0])]
    assert sum(len({i for i, _ in expected[q]} & {i for i, _ in got[q]}) for q in expected) / (20 * len(expected)) >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.0, -1.0]), (0, [9.0, 9.0]), (1, [0.5, 0.5])]
    got = found(spark, rows, k=20, kind="array<double>")
    assert sorted(i for i, _ in got[20]) == [0, 0, 1]  # rows of id 1 and equal scores are one candidate
    assert all(i != 0 for i, _ in got[0])
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0, 2.0])]) == {}


def test_only_pairs_that_reach_the_bound_are_added_up(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(4000, 64)).astype(np.float32)
    index = A.Index(rows[:2000], 1)
    index.tune(np.arange(2000), rows[:2000], 20, 500)
    codes, q = index.place(rows)[1], rows[:40]
    every = np.array([A.exact(x[None, :], rows) for x in q])
    bound = np.sort(every, axis=1)[:, -150]  # equal to a score: that pair is in
    seen, exact = [], A.exact
    monkeypatch.setattr(A, "exact", lambda a, b: seen.append(len(b)) or exact(a, b))
    of, r, s = A.search_list(index, 0, q, bound, rows, codes, 20)
    close = index.approximate(q, 0, codes).T >= (bound - index.slack)[:, None].astype(np.float32)
    assert sorted(zip(of, r, s)) == sorted((i, j, every[i, j]) for i, j in zip(*np.nonzero(close & (every >= bound[:, None]))))
    assert sum(seen) <= 40 * 151 < 40 * 201  # all that pass the approximate scores, up to 201 a query, before


@pytest.mark.parametrize("size", [1e-160, 1e-30, 1.0, 1e30, 1e160])
def test_the_bound_of_the_matrix_product_loses_no_pair(size):
    rng = np.random.default_rng(4)
    rows, q = rng.normal(size=(300, 24)) * size, rng.normal(size=(20, 24)) * size
    every = np.array([[A.exact(x, y) for x in q] for y in rows])
    for at in (0, 150, 299):  # bounds that are scores themselves
        assert A.may_reach(q, rows, every[at])[every >= every[at]].all()
    assert A.may_reach(q, rows, np.full(20, -np.inf)).all() and A.may_reach(q, rows[:0], every[0]).shape == (0, 20)
