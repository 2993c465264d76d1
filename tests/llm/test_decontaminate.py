"""Leaks against exact containment, with planted copies, paraphrases and clean texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def plain_words(text):
    return D.words_of(pa.array([text]))[0].tolist()


def shingles(text):
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_table_equals_exact_containment(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.leaked_items(docs, items).collect()}
    own = {r.item_id: shingles(r.text) for r in items.collect()}
    share = {}
    for r in docs.collect():
        s = shingles(r.text)
        share |= {(r.doc_id, i): len(s & x) / len(x) for i, x in own.items() if x and s & x}
    assert {k for k, v in share.items() if v >= 0.8} <= got
    assert all(share.get(k, 0) > 0.3 for k in got)


def corpus():
    rng = random.Random(0)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ar", "el", "ion", "ter", "und", "osh", "ick", "emp")] + ["the", "of", "and"] * 20
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    unlike = lambda k, n: " ".join(f"item{k}w{i}" if i % 3 else rng.choice(words) for i in range(n))
    items = [(k, unlike(k, n)) for k, n in enumerate([5, 8, 12, 30, 47, 48, 49, 120])] + [(8, "a few words"), (9, None), (None, "no id for this item at all here"), (10, unlike(3, 30))]
    docs, planted = [(k, text(rng.randint(1, 400))) for k in range(300)], {}
    for k, (item, passage) in enumerate(items[:8]):
        for j, shape in enumerate(("{0}", "{1} {0} {1}", "{1}\n\n{0}", "{0}. {1}")):
            doc = 1000 + 10 * k + j
            docs.append((doc, shape.format(passage.upper() if j == 1 else passage, text(90))))
            planted[doc] = item
    return items, docs, planted, text


def frames(spark, items, docs):
    return spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id long, text string, leaks string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


def test_copies_are_found_wherever_they_stand(spark):
    items, docs, planted, _ = corpus()
    found = D.leaked_items(*frames(spark, items, docs)).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert {(d, i) for d, i in planted.items()} <= got
    assert {d for d, _ in got} <= set(planted)
    assert all(r.kind == "copy" for r in found)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items, docs, planted, _ = corpus()
    monkeypatch.setattr(D, "ITEMS", 2)
    monkeypatch.setattr(D, "BLOCKS", 3)
    got = {(r.doc_id, r.item_id) for r in D.leaked_items(*frames(spark, items, docs)).collect()}
    assert set(planted.items()) <= got and {d for d, _ in got} <= set(planted)


def test_paraphrases_need_the_answer(spark):
    items, docs, _, text = corpus()
    words = items[3][1].split()
    edited = [w if i % 4 or i > 20 else "changed" for i, w in enumerate(words)]
    other = [w if i % 4 else "changed" for i, w in enumerate(words)]
    docs = docs[:200] + [(1, " ".join(edited)), (2, f"{text(70)} {' '.join(other)}")]
    assert 0.6 <= sum(a == b for a, b in zip(edited, words)) / len(words)
    got = {r.doc_id: r.kind for r in D.leaked_items(*frames(spark, items[3:4], docs)).collect()}
    assert got.get(1) in ("paraphrase", "copy") and 2 not in got
    answered = spark.createDataFrame([(3, items[3][1], " ".join(other[4:8]))], "item_id long, text string, answer string")
    got = {r.doc_id: r.kind for r in D.leaked_items(frames(spark, items, docs)[0], answered, "answer").collect()}
    assert got[2] == "paraphrase"


def test_a_passage_that_most_documents_copy_is_found(spark):
    items, docs, planted, text = corpus()
    docs = docs[:100] + [(2000 + k, f"{text(20)} {items[3][1]} {text(20)}") for k in range(300)]
    got = {r.doc_id for r in D.leaked_items(*frames(spark, items[:8], docs)).collect()}
    assert got == {2000 + k for k in range(300)}


def test_common_passages_are_found_among_words_of_other_items(spark):
    rng = random.Random(4)
    words = [f"{a}{b}{c}{d}" for a in "bcdfghjklm" for b in ("ar", "el", "ion", "ter", "und", "osh", "ick", "emp") for c in "nprstvwxyz" for d in ("", "a", "e", "o", "u")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(0, text(15)), (1, text(20)), *((k, text(48)) for k in range(2, 250))]
    docs = [(k, text(48)) for k in range(180)]
    for k in range(400):  # each in a third of all runs
        n = 48 - len(items[k % 2][1].split())
        docs.append((1000 + k, f"{text(k % n)} {items[k % 2][1]} {text(n - k % n)}"))
    planted = {(1000 + k, k % 2) for k in range(400)}
    edited = " ".join(w if i % 7 != 3 else f"{w} new" for i, w in enumerate(items[1][1].split()))
    docs += [(3000 + k, f"{text(k)} {edited} {text(20)}") for k in range(16)]
    planted |= {(3000 + k, 1) for k in range(16)}
    df, bench = frames(spark, items, docs)
    assert {(r.doc_id, r.item_id) for r in D.leaked_items(df, bench).collect()} == planted


def test_subsequence_equals_the_plain_program():
    rng = random.Random(1)
    for _ in range(200):
        own = [rng.randint(0, 9) for _ in range(rng.randint(5, 20))]
        part = [rng.randint(0, 12) for _ in range(rng.randint(0, 40))]
        block = D.Block([])
        block.passages, block.answers = [np.array(own, np.uint64)], [np.array(own, np.uint64)]
        most = int(1.25 * len(own)) + 2

        def lcs(b, own=own):
            t = [[0] * (len(own) + 1) for _ in range(len(b) + 1)]
            for i, x in enumerate(b):
                for j, y in enumerate(own):
                    t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
            return t[-1][-1]

        best = max((lcs(part[i : i + most]) for i in range(len(part))), default=0)
        got = block.leak(np.array(part, np.uint64), 0, len(part), 0)
        if best >= 0.8 * len(own):
            assert got == (best, "copy")
        else:
            assert got is None or (got[0] == best and got[1] == "paraphrase")


def test_odd_rows_and_empty_tables(spark):
    items, docs, planted, _ = corpus()
    odd = [(1, None), (None, items[3][1]), (2, ""), (3, items[3][1]), (3, items[3][1]), (4, "x " * 50_000 + items[3][1])]
    df, bench = frames(spark, items, odd)
    got = D.with_leaks(df, bench)
    assert got.columns == ["doc_id", "text", "leaks"] and got.count() == 6
    kept = D.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert {(r.doc_id, r.item_id) for r in D.leaked_items(df, bench).collect()} == {(None, 3), (3, 3), (4, 3)}
    assert D.leaked_items(df.limit(0), bench).count() == 0
    assert D.without_leaks(df, bench.limit(0)).count() == 6
    assert D.without_leaks(df, bench.where("item_id = 8")).count() == 6


def test_items_of_few_words_are_found_word_for_word(spark):
    items = [(1, "Two Words"), (2, "one"), (3, "--"), (4, "a b c d"), (5, "two words")]
    docs = [(1, "here are two, WORDS."), (2, "two other words"), (3, "words two"), (4, "x a b c"), (5, "d a b c d"), (6, "One."), (7, None)]
    got = {(r.doc_id, r.item_id): (r.cosine, r.kind) for r in D.leaked_items(*frames(spark, items, docs)).collect()}
    assert got == {k: (None, "copy") for k in [(1, 1), (1, 5), (5, 4), (6, 2)]}


def test_a_space_of_few_dimensions_finds_paraphrases_of_many_items(spark):
    """1000 items and the same number of jobs as 40; every edited passage is found though the space has an eighth of the passages' dimensions."""
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bcdfghjklmnprst" for b in ("ar", "el", "ion", "ter", "und", "osh", "ick", "emp") for c in "aeioudnrt"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randint(15, 60))) for k in range(1000)]
    docs, planted = [(k, text(rng.randint(1, 300))) for k in range(400)], set()
    for k in range(0, 1000, 4):
        own = items[k][1].split()
        edited = [w if i % 6 != 5 or i > len(own) * 0.7 else rng.choice(words) for i, w in enumerate(own)]
        docs.append((5000 + k, f"{text(k % 50)} {' '.join(edited)} {text(k % 37)}"))
        planted.add((5000 + k, k))
    df, bench = frames(spark, items, docs)
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for n in (40, 1000):
        spark.sparkContext.setJobGroup(f"leaks{n}", "")
        got = {(r.doc_id, r.item_id) for r in D.leaked_items(df, bench.where(F.col("item_id") < n)).collect()}
        jobs.append(len(tracker.getJobIdsForGroup(f"leaks{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert D.Block([(*x, None) for x in items]).rank <= 192
    assert len(planted & got) / len(planted) >= 0.98 and got <= planted and jobs[0] == jobs[1]
