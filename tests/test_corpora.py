"""Corpus builders against plain Python's codecs."""

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.operators import matching as M
from tracewell.operators import provenance as P
from tracewell.plans import registry
from tracewell.sources import corpora, reports, trees

TEXTS = {"en": "All are equal.", "fr": "Égaux en dignité", "de": "Würde", "es": "mañana", "zh": "你好世界", "ja": "こんにちは", "ko": "안녕", "ru": "Привет", "ar": "مرحبا"}


def texts(spark):
    return spark.createDataFrame([*TEXTS.items(), ("en", None), ("xx", "no plan has it")], "lang string, text string")


def found(items):
    return {(r.bucket, r.item_id): bytes(r.payload) for r in items.collect()}


def test_multilingual_items_are_strict(spark):
    got = found(corpora.multilingual(texts(spark)))
    assert got[("multilingual_utf8", "text_ar_utf8")] == TEXTS["ar"].encode()
    assert got[("multilingual_shiftjis", "text_ja_shiftjis")] == TEXTS["ja"].encode("shift_jis")
    assert len(got) == sum(map(len, corpora.MULTILINGUAL.values()))
    assert found(corpora.multilingual(texts(spark), plan={"iso-8859-1": ["fr", "ja"]})) == {("multilingual_iso88591", "text_fr_iso88591"): TEXTS["fr"].encode("latin-1")}
    assert found(corpora.multilingual(texts(spark).limit(0))) == {}


def test_mails(spark):
    got = found(corpora.mails(texts(spark), "a@example.invalid", "b@example.invalid", "s", "d"))
    assert len(got) == len(corpora.MAILS)
    assert got[("email_mime", "email_ascii_en")] == (
        b"From: a@example.invalid\r\nTo: b@example.invalid\r\nSubject: s\r\nDate: d\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=ascii\r\nContent-Transfer-Encoding: 7bit\r\n\r\nAll are equal."
    )


def test_pages_and_plain_starts(spark):
    pages = [("p", "one", b"abc"), ("p", "cut", "aé".encode() + b"x"), ("p", "bad", b"a\xffb"), ("p", "empty", b"")]
    got = found(corpora.pages(spark.createDataFrame(pages, corpora.ITEM.replace("payload", "content")), most=3))
    # the continuation byte at the end goes, its lead byte stays; an undecodable byte becomes U+FFFD before the cut
    assert got == {("p", "one"): b"abc", ("p", "cut"): b"a\xc3", ("p", "bad"): b"a\xef", ("p", "empty"): b""}
    got = found(corpora.plain_starts(spark.createDataFrame([("r", b"abcdef", 4)], "item_id string, content binary, most int")))
    assert got == {("rfc_ascii", "r"): b"abcd"}


def test_malformed_and_random(spark):
    got = found(corpora.malformed(spark, *(TEXTS[x] for x in ("en", "fr", "zh", "ja"))))
    assert got[("malformed", "utf8_double_encoded_fr")] == TEXTS["fr"].encode().decode("latin-1").encode()
    one = spark.createDataFrame([(TEXTS["fr"],)], "t string").select(corpora.twice_encoded(F.col("t")).alias("x")).first().x
    assert bytes(one) == got[("malformed", "utf8_double_encoded_fr")]
    rng, packed = random.Random(5), b""
    for _ in range(12):
        x = bytes(rng.randint(0, 255) for _ in range(rng.randint(0, 9)))
        packed += len(x).to_bytes(4, "big") + x
    assert found(corpora.random_control(spark, 5, 12, 9)) == {("random_control", "random_fuzz"): packed}


def test_written_corpus_is_read_back(spark, tmp_path):
    items = corpora.snippets(spark)
    corpora.write_corpus(items, corpora.manifest(items, "synthesized", "here", "free", "2026-05-28"), str(tmp_path))
    rows = trees.corpus(spark, str(tmp_path)).collect()
    assert {(r.item_id, bytes(r.payload)) for r in rows} == set(corpora.SNIPPETS) and all(r.ok for r in rows)
    row = corpora.manifest(items, "synthesized", "here", "free", "2026-05-28").where("item_id = 'digits'").first()
    assert (row.size_bytes, row.sha256) == (10, hashlib.sha256(b"1234567890").hexdigest())


def test_greedy_rounds_and_the_sequential_rule_agree(spark):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(3)}", rng.randrange(12), rng.randrange(12), rng.randrange(6) / 8) for _ in range(300)] + [("p0", None, 1, 0.0), ("p0", 1, 1, None)]
    candidates = spark.createDataFrame(rows, "pair string, i long, j long, distance double")
    expected, used = set(), set()
    for pair, i, j, d in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[3], r[1], r[2])):
        if ((pair, "i", i) not in used) and ((pair, "j", j) not in used):
            used |= {(pair, "i", i), (pair, "j", j)}
            expected.add((pair, i, j, d))
    for tail in (0, 60, 1000):
        assert {tuple(r) for r in M.mutual_greedy(candidates, tail).collect()} == expected
    assert M.mutual_greedy(candidates.limit(0)).count() == 0


def test_patch_documents_and_console(spark):
    one = spark.createDataFrame([("x", 0.5)], "name string, value double")
    two = spark.createDataFrame([(2,), (1,)], "n int")
    got = json.loads(reports.patch({"/independent/one": one, "/independent/two": two}, one).first().value)
    assert got["rfc6902_ops"] == [{"op": "add", "path": "/independent/one", "value": {"name": "x", "value": 0.5}}, {"op": "add", "path": "/independent/two", "value": [{"n": 1}, {"n": 2}]}]
    assert got["additions"] == {"independent.one": {"name": "x", "value": 0.5}, "independent.two": [{"n": 1}, {"n": 2}]} and got["comparison"] == [{"name": "x", "value": 0.5}]
    assert json.loads(reports.patch({"/a": two.limit(0)}).first().value)["additions"] == {"a": []}
    expected = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, value string")
    shown = reports.console_table(P.reconcile(expected, expected.where("name = 'a'")))
    assert [x.split()[-1] for x in shown.splitlines()] == ["agrees", "YES", "NO", "False"]


@pytest.mark.parametrize("name", sorted(registry.PYTHON_SQL))
def test_queries_in_python_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got, expected = registry.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(registry.PYTHON_SQL[name]).df()
    rows = lambda df: sorted(tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(expected.columns)].itertuples(index=False))
    assert rows(got) == rows(expected)
