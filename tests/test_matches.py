"""Gated, in-order and greedy matches against plain loops, and the match queries that need Python against their SQL."""

import math
import random

import numpy as np
import pytest
from test_oracles import SF, con, rows  # noqa: F401
from test_plans import plan

from tracewell.operators import matching as M
from tracewell.operators import nearest as N
from tracewell.plans import registry

SCHEMA = "pair string, id int, order int, arity int, tot int, cyc int, depth int, ret int, loop int, h map<string,int>"


def cosine(x, y):
    norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0.0


def side(rng, n):
    """Few histograms, some of them empty or all zero, so that copies and ties are common; sizes at the gates' ends; orders that aren't the ids'."""
    return [("p", k, n - k, rng.randint(0, 3), rng.choice([0, 1, 2, 3, 67, 100, 150, 151, rng.randint(1, 400)]), 3, rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 1), rng.choice([{}, {"a": 0}, {c: rng.randint(0, 2) for c in "abc"}])) for k in range(n)]


@pytest.mark.parametrize("block", [9, 50000])
@pytest.mark.parametrize("best, near, equal, low, high", [(M.naive_best, [3], [], 0.5, 2.0), (M.strict_best, [3, 6, 7], [8], 0.67, 1.5)])
def test_gated_best_equals_the_plain_loop_in_any_blocks(spark, monkeypatch, block, best, near, equal, low, high):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(7)
    a, b = side(rng, 60), side(rng, 70)
    expected = {}
    for x in a:
        found = [(cosine(x[9], y[9]), -y[2], y[1]) for y in b if x[4] and low <= y[4] / x[4] <= high and all(abs(x[c] - y[c]) <= 1 for c in near) and all(x[c] == y[c] for c in equal)]
        expected[x[1]] = (max(found)[2], max(found)[0]) if found else (None, 0.0)
    assert {r.id_a: (r.id_b, r.cosine) for r in best(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()} == expected


@pytest.mark.parametrize("name", ["j5_naive_match", "j6_strict_match", "q17_method_trace", "q18_gate_sweep", "q19_null_panel"])
def test_no_join_makes_the_pairs_of_descriptors(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "FlatMapCoGroupsInArrow" in text and "map_zip_with" not in text and "text#" not in text


@pytest.mark.parametrize("name", ["j4_in_order_matches", "j5_naive_match", "j6_strict_match", "q8_greedy_matches", "q17_method_trace", "q18_gate_sweep", "q19_null_panel"])
def test_match_query_equals_sql(spark, con, name):  # noqa: F811
    found, expected = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.PYTHON_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_in_order_kernel_equals_the_plain_loop():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (300, 3)).astype(float), rng.integers(0, 3, (250, 3)).astype(float)
    free, expected = list(range(len(b))), []
    cos = lambda x, y: (lambda n: float(x @ y) / n if n else 0.0)(math.sqrt(x @ x) * math.sqrt(y @ y))
    for i, x in enumerate(a):
        best = max(free, key=lambda j: cos(x, b[j]), default=None)
        if best is not None and cos(x, b[best]) >= 0.9:
            expected.append((i, best, cos(x, b[best])))
            free.remove(best)
    assert list(zip(*(v.tolist() for v in N.in_order(a, b, 0.9)))) == expected


def test_greedy_matches_pair_every_two_sources(spark):
    pairs = {r.pair for r in registry.QUERIES["q8_greedy_matches"](spark, SF).select("pair").distinct().collect()}
    assert pairs == {f"src{i}>src{j}" for i in range(20) for j in range(20) if i != j}


@pytest.mark.parametrize("n_a, n_b, spread", [(90, 70, 3), (40, 120, 2), (150, 150, 6), (0, 5, 3)])
def test_greedy_kernel_equals_the_plain_loop(n_a, n_b, spread):
    rng = np.random.default_rng(n_a)
    a, b = rng.integers(0, spread, (n_a, 3)).astype(float), rng.integers(0, spread, (n_b, 3)).astype(float)
    x, y = rng.integers(0, 3, (n_a, 2)).astype(float), rng.integers(0, 4, (n_b, 2)).astype(float)
    rel = lambda u, v: abs(u - v) / (u + v) if u + v else 0.0
    cos = lambda u, v: (lambda n: float(u @ v) / n if n else 0.0)(math.sqrt(u @ u) * math.sqrt(v @ v))
    every = sorted((round(0.6 * (1 - cos(a[i], b[j])) + 0.2 * rel(x[i, 0], y[j, 0]) + 0.2 * rel(x[i, 1], y[j, 1]), 9), i, j) for i in range(n_a) for j in range(n_b))
    used_i, used_j, expected = set(), set(), []
    for distance, i, j in every:
        if i not in used_i and j not in used_j:
            used_i.add(i), used_j.add(j), expected.append((i, j, abs(distance)))
    i, j, distance = N.greedy(a, x, b, y)
    assert list(zip(i.tolist(), j.tolist(), distance.tolist())) == expected
