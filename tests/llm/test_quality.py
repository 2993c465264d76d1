"""Held-out accuracy of the classifier, and its parts against plain versions."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.llm import ngram
from tracewell.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, Q.training_rows(labels))
    rows = Q.score(docs, model).join(labels, "doc_id").where(Q.held_out()).collect()
    assert len(rows) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.99 and np.mean(np.array(good) >= 0.3) > 0.99 and np.mean(np.array(bad) >= 0.3) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)


def test_batches_do_not_change_features():
    texts = ["Great words here", None, "", "a a a b", "ÄÖ!! x", "w " * 3000]
    row, feature = ngram.indicators(pa.array(texts), 18)
    for i, t in enumerate(texts):
        alone = ngram.indicators(pa.array([t]), 18)[1]
        assert feature[row == i].tolist() == alone.tolist()
    assert len(ngram.indicators(pa.array([None]), 18)[1]) == 1


def test_descent_solves_the_dual():
    """At the optimum each weight of the box meets the optimality conditions."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=40) > 0, 1.0, -1.0)
    scale, cost = np.ones(6), np.full(40, 0.7)
    lists = [f if len(f) else np.array([0]) for f in (np.flatnonzero(r > 0) for r in x)]
    rows = Q.Rows(np.cumsum([0, *map(len, lists)]), np.concatenate(lists).astype(np.int32))
    rows.scale(scale)
    w = rows.descend(np.arange(40), 6, y, cost, epochs=2000)
    dense = np.zeros((40, 6))
    for i, f in enumerate(lists):
        dense[i, f] = 1 / np.sqrt(len(f))
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (dense @ w))).sum()
    for _ in range(300):  # no nearby point is better
        other = w + rng.normal(size=6) * rng.choice([0.01, 0.1, 1])
        assert 0.5 * other @ other + (cost * np.maximum(0, 1 - y * (dense @ other))).sum() >= primal - 1e-3


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good fine words" if i % 2 else "BAD!! BAD!! ###", 9.0) for i in range(40)] + [(50, None, 1.0), (51, "", 1.0), (None, "x", 1.0), (52, "z" * 100_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, None), (2, 7), (1, 1), (None, 1)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    got = {r.doc_id: r.score for r in Q.score(docs, model, ["doc_id", "score"]).collect()}
    assert len(got) == 44 and got[1] > 0.7 and got[0] < 0.3 and got[50] == got[51] and all(0 <= s <= 1 for s in got.values())
    for subset, share in ((labels.where("quality = 1"), 1.0), (labels.limit(0), 0.5)):
        scores = {round(r.score, 3) for r in Q.score(docs, Q.fit(docs, subset)).collect()}
        assert scores == {share}
    assert Q.score(docs.limit(0), model).count() == 0
    assert Q.fit(docs, labels, sample_rows=10).scores(pa.array(["x"])).shape == (1,)
    assert sorted(got, key=lambda x: (x is None, x))[-1] is None


def plain_scores(rows, queries, bits=18):
    """The same model in plain numpy with dense vectors: rows (text, label) in the sample's order."""
    features = lambda t: ngram.indicators(pa.array([t]), bits)[1]
    y = np.array([1.0 if label else -1.0 for _, label in rows])
    lists = [features(t) for t, _ in rows]
    counts = {c: np.ones(1 << bits) for c in (1.0, -1.0)}
    for f, c in zip(lists, y):
        counts[c][f] += 1
    r = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    names = np.unique(np.concatenate(lists))
    x = np.array([np.isin(names, f) * r[names] / np.sqrt((r[f] ** 2).sum()) for f in lists])
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def solve(some):
        w, alpha, order, rng = np.zeros(len(names)), np.zeros(len(y)), some.copy(), np.random.default_rng(0)
        for _ in range(12):
            rng.shuffle(order)
            most = 0.0
            for i in order:
                new = np.clip(alpha[i] - (y[i] * (w @ x[i]) - 1), 0, cost[i])
                most, w, alpha[i] = max(most, abs(new - alpha[i])), w + (new - alpha[i]) * y[i] * x[i], new
            if most < 1e-3:
                break
        return w

    every, margins = np.arange(len(y)), np.zeros(len(y))
    for k in (0, 1):
        margins[every % 2 == k] = x[every % 2 == k] @ solve(every[every % 2 != k])
    (a, b), w = Q._logistic(margins, y), solve(every)
    full = np.zeros(1 << bits)
    full[names] = w
    dots = [full[f] @ r[f] / max(np.sqrt((r[f] ** 2).sum()), 1e-12) for f in map(features, queries)]
    return 1 / (1 + np.exp(-(a * np.array(dots) + b)))


def test_scores_are_those_of_a_plain_program(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(Q.training_rows(labels), "doc_id").withColumn("hash", F.xxhash64("doc_id")).orderBy("hash").collect()
    every = docs.orderBy("doc_id").collect()
    want = plain_scores([(r.text, r.quality) for r in rows], [r.text for r in every])
    got = {r.doc_id: r.score for r in Q.score(docs, Q.fit(docs.repartition(5), Q.training_rows(labels))).collect()}
    assert len(rows) > 30 and np.abs(np.array([got[r.doc_id] for r in every]) - want).max() < 1e-4


def test_sample_is_bounded_by_rows_and_features(spark):
    docs = spark.createDataFrame([(7, f"text {i} of one id") for i in range(300)] + [(8, "another one")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    def learnt(rows, features):
        return set(Q.fit(docs, labels, sample_rows=rows, sample_features=features).w.tolist()) != {0.0}

    # the first row by hash is that of doc_id 8 alone, which has one class
    assert learnt(16_000, 16_000_000) and not learnt(16_000, 1) and not learnt(1, 16_000_000)
    assert Q.fit(docs, labels, sample_features=1).scores(pa.array(["x"]))[0].round(3) in (0.0, 1.0)


def test_ties_and_repeats_change_nothing(spark):
    rows = [(i, "good fine words" if i % 2 else "BAD!! ###") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    once, twice = (Q.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels.union(labels)) for r, n in ((rows, 1), (rows + rows[::-1], 7)))
    assert once.w.tolist() == twice.w.tolist() and (once.a, once.b) == (twice.a, twice.b)
