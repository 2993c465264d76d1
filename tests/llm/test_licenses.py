"""License scans against exact containment of shingles."""

import random

import pyarrow as pa

from tracewell.llm import licenses as L
from tracewell.llm.common import NOT_ALNUM

SF = "/root/testdata/sf0.01"


def plain_words(text):
    raw = (text or "").lower().encode()
    return bytes(32 if b in NOT_ALNUM else b for b in raw).split()


def shingles(text):
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_table_equals_exact_containment(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.template) for r in L.scan(docs).collect()}
    own = [shingles(t) for _, t in L.TEMPLATES]
    expected = {(r.doc_id, n) for r in docs.collect() for n, s in enumerate(own) if len(s & shingles(r.text)) >= 0.8 * len(s)}
    assert got == expected and len(got) > 20


def test_edited_and_long_templates():
    rng = random.Random(0)
    noise = lambda n: " ".join(f"n{rng.randint(0, 10**6)}" for _ in range(n))
    long = " ".join(f"t{i}" for i in range(400))
    templates = (("short", "one two three four five"), ("mid", " ".join(f"m{i}" for i in range(40))), ("long", long))
    t = L.Templates(templates)
    for name, text in templates:
        n = [x for x, _ in templates].index(name)
        for before in (0, 1, 3, 17, 100):
            words = text.split()
            if name != "short":
                for at in rng.sample(range(len(words)), len(words) // 80):
                    words[at] = "edited"
            source = f"{noise(before)} {' '.join(words)} {noise(30)}"
            share = len(shingles(source) & shingles(text)) / len(shingles(text))
            found = [m for m in t.matches(pa.array([source]))[0] if m[0] == n]
            assert share >= 0.8 and len(found) == 1 and abs(found[0][1] - share) < 1e-9
            assert found[0][2] <= before + 5 and found[0][3] >= before + len(words) - 5
    scattered = f"one two three {noise(5)} four five"
    assert t.matches(pa.array([scattered, " ".join(long.split()[:200])])) == [[], []]


def test_bands_find_similar_windows():
    """At a similarity of 0.6 or more a band collides (the docstring's probability)."""
    rng = random.Random(3)
    misses = 0
    for k in range(200):
        base = [f"b{k}x{i}" for i in range(24)]
        copy = list(base)
        copy[rng.randrange(4, 20)] = "edited"
        t = L.Templates((("x", " ".join(base)),))
        misses += not t.matches(pa.array([f"{'pad ' * rng.randint(0, 9)}{' '.join(copy)} tail"]))[0] and len(shingles(" ".join(copy)) & shingles(" ".join(base))) >= 0.8 * 20
    assert misses == 0


def test_several_matches_and_odd_rows(spark):
    text = "Released under the MIT License. " + "filler words here " * 30 + "released UNDER the mit-license!"
    rows = [(1, text), (2, None), (None, "Released under the MIT License"), (3, ""), (4, "x"), (4, "x"), (5, "é " * 30_000 + "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.license, r.first_word) for r in L.scan(df).collect()), key=str)
    assert got == sorted([(1, "MIT", 0), (1, "MIT", 95), (None, "MIT", 0), (5, "CC-BY-NC-4.0", 30_000)], key=str)
    assert L.scan(df.limit(0)).count() == 0
    assert L.scan(df, (("tiny", "four words are few"),)).count() == 0
