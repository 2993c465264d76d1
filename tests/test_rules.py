"""Scalar rules, similarities, statistics and graphs against known values and plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.operators import graph as G
from tracewell.operators import matching as M
from tracewell.operators import provenance as P
from tracewell.operators import similarity as S
from tracewell.operators import statistics as T

NAN = float("nan")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("degree, bucket", [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (7, 3), (8, 4)])
def test_degree_bucket(spark, degree, bucket):
    assert one(spark, C.degree_bucket(F.lit(degree))) == bucket


def test_scalar_rules(spark):
    both = lambda a, b: one(spark, C.rel_diff(F.lit(a), F.lit(b)))
    assert (both(0.0, 0.0), both(0.0, 3.0), both(1.0, 3.0)) == (0, 1, 0.5)
    assert [one(spark, C.confidence_bucket(F.lit(x).cast("double"))) for x in (None, 0.9, 0.5, 0.49)] == ["none", "high", "med", "low"]
    fold = lambda e, c: (one(spark, C.report_bucket(F.lit(e), F.lit(c))), one(spark, C.confidence_bucket(F.lit(c))))
    assert fold("WINDOWS-1252", 0.95) == fold("ascii", 1.0)
    assert fold("WINDOWS-1252", 0.66) == fold("windows-1252", 0.65)
    assert fold("utf-8", 0.99) != fold("utf-8", 0.83)
    assert [one(spark, C.band(F.lit(c))) for c in (8, 5, 3, 2)] == ["load-bearing", "substantive", "minor", "trivial"]
    assert one(spark, C.pilot_label(F.lit("ERR: x"))) == "ERR: x" and one(spark, C.pilot_label(F.lit("UTF_8"))) == "utf-8"
    assert one(spark, C.normalised_text(F.lit("a \t\r\n\n  b\x0b\n"))) == "a\n  b"
    assert one(spark, C.shingles(F.array(*map(F.lit, "abcd")), 5)) == [] and one(spark, C.shingles(F.array(*map(F.lit, "abcdef")), 5)) == ["a b c d e", "b c d e f"]
    assert one(spark, C.number_after(F.lit("shared=5 strict=3; strict=9"), "strict")) == 3


def test_similarities_of_known_histograms(spark):
    known = {
        "six": dict(ExceptHandler=12, For=72, If=346, Raise=10, Return=191, Try=12, While=1, With=4, Yield=3, YieldFrom=1),
        "seven": dict(ExceptHandler=32, For=135, If=355, Raise=12, Return=253, Try=33, While=12, With=16),
    }
    hist = spark.createDataFrame([(s, k, v) for s, h in known.items() for k, v in h.items()], "side string, key string, cnt long")
    assert S.cosine(hist).first().cosine == pytest.approx(0.9844014929937703)
    topo = [("six", 342, 488, 0.004184459192948157, 342, 1.4269005847953216, 1.4269005847953216, 34, 24), ("seven", 358, 659, 0.005156252445112123, 358, 1.8407821229050279, 1.8407821229050279, 44, 42)]
    names = ["nodes", "edges", "density", "sccs", "mean_in", "mean_out", "max_in", "max_out"]
    frame = spark.createDataFrame(topo, "side string, nodes long, edges long, density double, sccs long, mean_in double, mean_out double, max_in long, max_out long")
    assert S.feature_similarity(frame, "side", names).first().similarity == pytest.approx(0.8808640269160583)
    sets = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("b", "y", 1), ("b", "z", 1)], "side string, key string, cnt int")
    assert S.jaccard(sets).first().jaccard == pytest.approx(2 / 3)
    multi = spark.createDataFrame([("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "c", 5)], "side string, key string, cnt int")
    assert S.overlap(multi).first().overlap == pytest.approx(1 / 3)
    empty = spark.createDataFrame([("p",), ("q",)], "side string")
    assert S.jaccard(sets.limit(0), empty, both_empty=1.0).first().jaccard == 1.0
    assert S.cosine(sets.limit(0), empty).first().cosine == 0.0


def test_auc_spearman_and_calibration(spark):
    rows = spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 1), ("g", 1.0, 0), ("h", 1.0, 1)], "g string, s double, y int")
    found = {r.g: r.auc for r in T.auc(rows, ["g"], "s", F.col("y") == 1).collect()}
    assert found["g"] == 0.75 and math.isnan(found["h"])
    rng = random.Random(1)
    data = [(1, rng.randint(0, 9), rng.randint(0, 9)) for _ in range(200)]

    def ranks(v):
        s = sorted(v)
        return [s.index(x) + (s.count(x) - 1) / 2 for x in v]

    rho = np.corrcoef(ranks([x for _, x, _ in data]), ranks([y for _, _, y in data]))[0, 1]
    assert T.spearman(spark.createDataFrame(data, "g int, x int, y int"), ["g"], "x", "y").first().rho == pytest.approx(rho)


def test_resampling_and_power(spark):
    a, b = next(T.numpy_draws(1, 5, 7, 3))
    rng = np.random.default_rng(3)
    assert (a == rng.integers(0, 5, size=5)).all() and (b == rng.integers(0, 7, size=7)).all()
    values = np.random.default_rng(0).normal(0.8, 0.05, 20)
    low = T.bca_lower(np.random.default_rng(1), values, 4000, 5.0)
    assert values.mean() - 4 * values.std() / math.sqrt(20) < low < values.mean()
    pos, neg = np.array([1.0, 3.0]), np.array([0.0, 2.0])
    assert T.sample_auc(pos, neg) == 0.75
    cells = spark.createDataFrame([(0, 5, 5, 5, 0.9, 0.35, 0.7), (1, 5, 5, 5, 0.6, 0.35, 0.7)], "cell int, families int, n_pos int, n_neg int, mean_auc double, tau double, theta double")
    power = {r.cell: r.power for r in T.power_map(cells, sims=200, boots=500).collect()}
    assert 0.7 < power[0] <= 1 and power[1] < 0.3
    assert T.calibration_spread(20, 400)["ece_mean"] > T.calibration_spread(320, 400)["ece_mean"]
    assert T.dose_power(8, 4, 0.3, 0.1, 50) > T.dose_power(8, 4, 0.0, 0.1, 50)


def brute_greedy(candidates):
    i_used, j_used, out = set(), set(), []
    for d, i, j in sorted(candidates):
        if i not in i_used and j not in j_used:
            i_used.add(i), j_used.add(j), out.append((i, j, d))
    return sorted(out)


def test_greedy_matches_equal_the_plain_loop(spark):
    rng = random.Random(2)
    candidates = [(round(rng.random(), 1), i, j) for i in range(12) for j in range(15) if rng.random() < 0.6]
    frame = spark.createDataFrame([("p", i, j, d) for d, i, j in candidates], "pair string, i int, j int, distance double")
    assert sorted((r.i, r.j, r.distance) for r in M.mutual_greedy(frame).collect()) == brute_greedy(candidates)


def test_in_order_matches_equal_the_plain_loop(spark):
    rng = random.Random(3)
    make = lambda n: [("p", rng.randint(0, 1), k, k, {c: rng.randint(0, 4) for c in "abc"}) for k in range(n)]
    left, right = make(10), make(10)
    cos = lambda x, y: (lambda d, m: d / m if m else 0.0)(sum(x[k] * y[k] for k in x), math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values())))
    used, expected = set(), []
    for _, sig, _, i, h in left:
        best, at = -1.0, None
        for _, sig2, _, j, g in right:
            if sig2 == sig and j not in used and cos(h, g) > best:
                best, at = cos(h, g), j
        if at is not None and best >= 0.5:
            used.add(at)
            expected.append((i, at))
    schema = "pair string, sig int, order int, id int, h map<string,int>"
    found = M.in_order_greedy(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    assert sorted((r.id_a, r.id_b) for r in found) == sorted(expected)


def test_strong_components_and_paths(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)]
    nodes = spark.createDataFrame([("g", i) for i in range(1, 9)], "g string, id int")
    frame = spark.createDataFrame([("g", a, b) for a, b in edges], "g string, src int, dst int")
    assert {r.id: r.component for r in G.strong_components(nodes, frame).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    t = G.topology(nodes, frame).first()
    assert (t.nodes, t.edges, t.sccs, t.max_in, t.max_out) == (8, 8, 5, 2, 2) and abs(t.density - 8 / 56) < 1e-12 and t.mean_in == t.mean_out == 1.0


def test_paths_of_any_length_and_cycles(spark):
    units = spark.createDataFrame([("g", i, 1) for i in range(12)], "g string, id int, loc int")
    chain = [("g", i + 1, i) for i in range(11)]
    found = {r.id: (r.layer, r.weight) for r in G.longest_paths(units, spark.createDataFrame(chain, "g string, id int, on int")).collect()}
    assert found[11] == (11, 12) and found[0] == (0, 1)
    for more in ([("g", 0, 11)], [("g", 5, 9)]):
        with pytest.raises(ValueError, match="cycle"):
            G.longest_paths(units, spark.createDataFrame(chain + more, "g string, id int, on int"))


def test_size_buckets_lose_no_match(spark):
    rng = random.Random(5)
    side = lambda n: [("p", k, k, rng.randint(0, 3), rng.choice([0, 1, 2, 3, 67, 100, 150, 151, rng.randint(1, 400)]), 3, 1, 1, 0, {c: rng.randint(0, 4) for c in "abc"}) for k in range(n)]
    schema = "pair string, id int, order int, arity int, tot int, cyc int, depth int, ret int, loop int, h map<string,int>"
    a, b = side(60), side(60)
    for best, low, high in ((M.naive_best, 0.5, 2.0), (M.strict_best, 0.67, 1.5)):
        found = {r.id_a: r.id_b is not None for r in best(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
        assert found == {x[1]: any(x[4] and abs(x[3] - y[3]) <= 1 and low <= y[4] / x[4] <= high for y in b) for x in a}


def test_pooled_bound_is_that_of_drawn_pairs():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1, 1, 25), rng.normal(0, 1, 25)
    plain = [T.sample_auc(pos[rng.integers(0, 25, 25)], neg[rng.integers(0, 25, 25)]) for _ in range(4000)]
    assert abs(T.pooled_lower(rng, pos, neg, 4000, 5.0) - np.quantile(plain, 0.05)) < 0.02


def test_class_verdicts_residuals_and_displayed(spark):
    d = lambda n, names: (n, names)
    schema = "cls string, method string, d struct<n:int,names:array<string>>"
    a = spark.createDataFrame([("C", "f", d(1, ["x"])), ("C", "g", d(1, ["y"])), ("D", "f", d(1, ["x"])), ("E", "f", d(0, [])), ("F", "f", d(2, []))], schema)
    b = spark.createDataFrame([("C", "f", d(1, ["x"])), ("C", "g", d(1, ["z"])), ("D", "f", d(2, ["x"])), ("F", "f", d(2, [])), ("G", "f", d(1, []))], schema)
    assert {r.cls: r.verdict for r in P.class_verdicts(a, b, ["n"]).collect()} == {"C": "renamed_args", "D": "diverged", "E": "removed_class", "F": "strict", "G": "added_class"}
    feats = spark.createDataFrame([("v", "k", "only_two"), ("w", "k", "only_two"), ("v", "k", "all"), ("w", "k", "all"), ("z", "k", "all"), ("v", "k", "api"), ("w", "k", "api")], "impl string, kind string, feature string")
    pairs = spark.createDataFrame([("v", "w")], "a string, b string")
    api = spark.createDataFrame([("v", "api")], "impl string, feature string")
    assert [r.feature for r in P.residual(feats, pairs, api).collect()] == ["only_two"]
    measured = spark.createDataFrame([("x", 0.6665), ("y", 2.675)], "name string, value double")
    shown = spark.createDataFrame([("x", "0.667"), ("y", "2.67")], "name string, value string")
    assert {r.name: r.agrees for r in P.displayed(measured, shown).collect()} == {"x": True, "y": False}


def test_reconciliation_reports_four_disagreements(spark):
    expected = [("jaccard", "0.333"), ("rate", "0.0"), ("n", "1000"), ("digest", "aa"), ("cosine", "0.984")]
    recomputed = [("jaccard", "0.667"), ("rate", "0.016"), ("n", "1064"), ("digest", "bb"), ("cosine", "0.9844")]
    found = P.reconcile(spark.createDataFrame(expected, "name string, value string"), spark.createDataFrame(recomputed, "name string, value string"))
    assert sorted(r.name for r in found.where("not agrees").collect()) == ["digest", "jaccard", "n", "rate"]
