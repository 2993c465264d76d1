"""Fingerprints and their components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import simhash as S
from tracewell.llm.common import Scratch
from tracewell.llm.components import components


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(items, linked):
    """items: (id, thing); the smallest id of each component."""
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i][1], items[j][1]):
                parent[root(i)] = root(j)
    low = {}
    for i, (key, _) in enumerate(items):
        low[root(i)] = min([x for x in (low.get(root(i)), key) if x is not None], default=None)
    return [low[root(i)] for i in range(len(items))]


def texts():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out + ["", None, "  \n ", "one", "One", "two words", "ÄÖ ü", "x " * 3000, "\x1f a\x00b", "a\xa0b c d e f"]


def test_fingerprints_and_components(spark):
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts())] + [(None, "one"), (5000, "unlike any other text here at all"), (5000, "unlike any other text here at all")]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, node int").repartition(4)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in S.near_copies(df).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    low = plain_components([(d, f) for (d, _), f in zip(rows, fps)], lambda a, b: (a ^ b).bit_count() <= 4)
    assert got == sorted(((d, f, c) for (d, _), f, c in zip(rows, fps, low)), key=str)


@pytest.mark.parametrize("count, per_chunk", [(100, 8), (10**7, 1), (10**10, 2)])
def test_links_keep_components_for_every_number_of_blocks_and_hot_keys(spark, monkeypatch, count, per_chunk):
    monkeypatch.setattr(S, "PER_CHUNK", per_chunk)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [base[k % 2] ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)), np.uint64(0)) for k in range(250)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)])).view(np.int64).tolist()
    scratch = Scratch(spark, "test")
    frame = spark.createDataFrame([(x, x) for x in fps], "node long, f0 long")
    roots = {r.node: r.root for r in components(S.links(S.block_keys(frame, count, 4), ["f0"], 4, scratch), scratch).collect()}
    low = plain_components([(x, x & (1 << 64) - 1) for x in fps], lambda a, b: (a ^ b).bit_count() <= 4)
    assert [roots.get(x, x) for x in fps] == low


def test_components_of_a_long_chain(spark):
    nodes = list(range(300))
    random.Random(1).shuffle(nodes)
    edges = spark.createDataFrame([(a, b) for a, b in zip(nodes, nodes[1:])] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(edges, Scratch(spark, "test")).collect()}
    assert {roots[n] for n in nodes} == {0} and roots[1001] == roots[1000] == 1000


def test_similar_copies_link_at_eight_tenths(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows, pairs = [], []
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(10, 190), 4):
            copy[at] = rng.choice(vocabulary)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        pairs.append((2 * k, 2 * k + 1))
    rows += [(900, rows[0][1]), (901, ""), (902, None), (903, "one two"), (904, "one two")]
    got = {r.doc_id: r.component_id for r in S.similar_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    text = dict(rows)
    near = [(a, b) for a, b in pairs if len(shingles(text[a]) & shingles(text[b])) / len(shingles(text[a]) | shingles(text[b])) >= 0.8]
    assert len(near) > 40 and all(got[a] == got[b] for a, b in near)
    assert len({got[a] for a, _ in pairs}) == 60  # unlike texts stay apart
    assert got[900] == got[0] and got[904] == 903 and 901 not in got


def plain_similar(rows, size=5):
    """Components by the Jaccard similarity of all pairs."""

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}

    items = [(d, shingles(t)) for d, t in rows]
    return plain_components(items, lambda a, b: len(a & b) / len(a | b) >= 0.8)


@pytest.mark.parametrize("small", [48, 2])
def test_similar_copies_are_decided_by_the_sets(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    monkeypatch.setattr(S, "PER_CHUNK", 1)
    rng = random.Random(3)
    text = lambda n: [f"z{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(150):  # 4 against 5 shingles: 0.8
        base = text(9)
        rows += [(10 * k, " ".join(base[:8])), (10 * k + 1, " ".join(base))]
    for k in range(150, 220):  # 12 against 17 shingles: 0.71; 14 against 18: 0.78
        base = text(22)
        rows += [(10 * k, " ".join(base[:16])), (10 * k + 1, " ".join(base[:21])), (10 * k + 2, " ".join(base[4:]))]
    base = text(60)
    for k in range(40):  # one group with links of all kinds
        copy = list(base)
        for at in rng.sample(range(60), rng.randrange(3)):
            copy[at] = text(1)[0]
        rows.append((5000 + k, " ".join(copy)))
    rows += [(9000, rows[0][1]), (9000, rows[0][1]), (None, rows[2][1]), (None, "only here and without id")]
    got = sorted(((r.doc_id, r.component_id) for r in S.similar_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=str)
    assert got == sorted(((d, c) for (d, _), c in zip(rows, plain_similar(rows))), key=str)


@pytest.mark.parametrize("small", [48, 2])
def test_similar_copies_meet_in_the_blocks_of_their_fingerprints(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    monkeypatch.setattr(S, "PER_CHUNK", 1)
    signatures = S.set_signatures
    monkeypatch.setattr(S, "set_signatures", lambda *a: signatures(*a).withColumn("keys", F.array("node")))  # no two sets share a band
    rng = random.Random(4)
    text = lambda n: [f"y{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(12):
        base = text(150)
        for j in range(8):
            copy = list(base)
            for at in rng.sample(range(150), rng.randrange(4)):
                copy[at] = text(1)[0]
            rows.append((10 * k + j, " ".join(copy)))
    rows += [(1000 + k, "same " * 3000 + " ".join(text(20))) for k in range(3)]  # few bits apart, but the sets differ
    fps = {d: plain_fingerprint(t, 5) for d, t in rows}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    few = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    got = sorted((r.doc_id, r.component_id) for r in S.similar_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    low = plain_components([(d, d) for d, _ in rows], lambda a, b: few(a, b) and near(a, b))
    assert got == sorted((d, c) for (d, _), c in zip(rows, low))
    assert sum(d != c for d, c in got) > 20 and few(1000, 1001) and not near(1000, 1001)
    assert any(near(a, b) and not few(a, b) for a, _ in rows for b, _ in rows)  # these are the bands' part


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_copies(empty).count() == 0 and S.similar_copies(empty).count() == 0
