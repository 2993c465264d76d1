"""Evidence fusion against the same sums in plain numpy, and accuracy on held-out rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.llm import language as L
from tracewell.llm.common import Scratch

SF = "/root/testdata/sf0.01"


def test_runs_equal_a_plain_count():
    texts = ["Aé b!", "", None, "ab", "  x  "]
    row, run = L.runs(pa.array(texts))

    def plain(text):
        raw = bytes(L._LETTER[b] for b in (text or "").encode())
        raw = b" " + raw + b" "
        return [raw[i : i + 3] for i in range(len(raw) - 2) if raw[i + 1] != 32 or (raw[i] != 32 and raw[i + 2] != 32)]

    counts = [len(plain(t)) for t in texts]
    assert np.bincount(row, minlength=len(texts)).tolist() == counts
    assert len(set(run.tolist())) == len({g for t in texts for g in plain(t)})


def test_fusion_equals_plain_sums(spark):
    rng = np.random.default_rng(0)
    names = ["aa", "bb", "und"]
    rows = []
    for i in range(60):
        host = f"h{rng.integers(4)}.d{rng.integers(2)}.{'x' if i % 3 else 'y'}"
        rows.append((i, rng.normal(-20, 5, 3).tolist(), ["aa", "bb", ""][rng.integers(3)], host, ".".join(host.split(".")[-2:]), host[-1]))
    rows += [(60, [0.0, 0.0, 0.0], "bb", rows[0][3], rows[0][4], rows[0][5]), (None, [-1.0, -9.0, -9.0], "", "", "", "")]
    frame = spark.createDataFrame(rows, "key long, likely array<double>, declared string, host string, domain string, suffix string")
    got = {r.key: r for r in L.fuse(frame, names, Scratch(spark, "t")).collect()}
    text = np.array([r[1] for r in rows]) * L.TEMPER
    own = np.exp(text - text.max(axis=1, keepdims=True))
    own /= own.sum(axis=1, keepdims=True)
    total = own.sum(axis=0)
    share = (total + 1) / (total + 1).sum()
    for i, r in enumerate(rows):
        same = lambda c: own[[k for k, o in enumerate(rows) if o[c] == r[c]]].sum(axis=0)  # noqa: E731, B023
        domain = np.maximum(same(4) - own[i], 0)
        domain = (domain + L.STRENGTH * share) / (domain.sum() + L.STRENGTH)
        host = own[[k for k, o in enumerate(rows) if o[3:5] == r[3:5]]].sum(axis=0)
        host = np.maximum(host - own[i], 0)
        prior = (host + L.STRENGTH * domain) / (host.sum() + L.STRENGTH)
        logs = text[i] + np.log(prior) + np.log((same(2) + 0.5) / (total + 1)) + np.log((same(5) + 0.5) / (total + 1))
        p = np.exp(logs - logs.max())
        p /= p.sum()
        assert got[r[0]].language == names[int(p.argmax())] and abs(got[r[0]].posterior - p.max()) < 1e-9


def test_accuracy_and_unknown_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs.where("doc_id % 5 <> 0"), "doc_id", "text", "lang")
    assert model.languages == ["de", "en", "es", "fr", "und"]
    held = docs.where("doc_id % 5 = 0")
    evidence = L.text_evidence(held, model, "doc_id", "text", "lang", "source")
    found = L.fuse(evidence, model.languages, Scratch(spark, "t")).collect()
    assert sum(r.text_language == r.declared for r in found) / len(found) > 0.97
    odd = spark.createDataFrame([(1, "Съешь ещё этих мягких французских булок да выпей чаю", "en", "s"), (2, "zqxj kvqz xxqj wvkq jqzx qqzz kjxv", "en", "s"), (3, None, "fr", "s"), (4, "", "fr", "s")], "doc_id long, text string, lang string, source string")
    got = {r.key: r.text_language for r in L.fuse(L.text_evidence(odd, model, "doc_id", "text", "lang", "source"), model.languages, Scratch(spark, "t")).collect()}
    assert got[1] == got[2] == "und"


def test_every_declared_language_is_learnt(spark):
    russian = "Съешь ещё этих мягких французских булок да выпей чаю"
    rows = [(k, f"these are plain words of text number {k}", "en") for k in range(3000)] + [(5000, russian, "RU "), (5001, russian, "ru"), (None, "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "el")]
    rows += [(6000 + k, f"word{k} of a rare tongue", f"r{k:03}") for k in range(260)] + [(7000, "x", "und"), (7001, "y", " "), (7002, "z", None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string").repartition(3)
    model = L.fit(docs.where("lang not like 'r0%' and lang not like 'r1%' and lang not like 'r2%' or lang is null"), "doc_id", "text", "lang", sample_rows=50)
    assert model.languages == ["el", "en", "ru", "und"]
    found = L.fuse(L.text_evidence(docs.where("lang in ('RU ', 'ru', 'el')"), model, "doc_id", "text", "lang", "source"), model.languages, Scratch(spark, "t")).collect()
    assert sorted((r.language, r.text_language) for r in found) == [("el", "el"), ("ru", "ru"), ("ru", "ru")]
    assert len(L.fit(docs, "doc_id", "text", "lang", sample_rows=50).languages) == 264


def test_other_evidence_decides_for_empty_text(spark):
    model = L.TextModel(["aa", "bb"], np.ones((2, 1 << L.BITS)))
    rows = [(i, [0.0, -30.0, -30.0] if i % 2 else [-30.0, 0.0, -30.0], "aa" if i % 2 else "bb", "one.d.x" if i % 2 else "two.d.x", "d.x", "x") for i in range(60)]
    rows += [(100, [0.0] * 3, "", "one.d.x", "d.x", "x"), (101, [0.0] * 3, "bb", "new.d.x", "d.x", "x")]
    frame = spark.createDataFrame(rows, "key long, likely array<double>, declared string, host string, domain string, suffix string")
    got = {r.key: r.language for r in L.fuse(frame, model.languages, Scratch(spark, "t")).collect()}
    assert got[100] == "aa" and got[101] == "bb"


def test_addresses_and_declarations():
    assert L.address("https://m.news.example.org:80/de/1?x") == ("m.news.example.org", "example.org", "org")
    assert L.address(None) == L.address("no address") == ("", "", "")
    assert L.address("http://[bad") == ("", "", "")
    assert L.declared('<!doctype html><HTML class=x LANG="de-AT">') == "de" and L.declared(None) == L.declared("<p lang=de>") == ""


def test_a_declaration_behind_a_long_start_is_found():
    long = "x" * 10_000
    page = "<html lang='fr'><body>"
    assert L.declared(f"<!-- {long} -->{page}") == L.declared(" " * 9000 + page) == L.declared(f"<script>{long}</script>{page}") == "fr"
    assert L.declared(f"<!-- <html lang=de> -->{page}") == L.declared(f"<SCRIPT>'<html lang=de>'</script >{page}") == "fr"
    assert L.declared("<!-- <html lang=de>") == L.declared("<style><html lang=de>") == ""


def test_no_training_rows_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    model = L.fit(empty, "doc_id", "text", "lang")
    assert model.languages == ["und"]
    rows = spark.createDataFrame([(1, "x", None, None), (1, "x", None, None), (None, None, "", "")], "doc_id long, text string, lang string, source string")
    got = L.fuse(L.text_evidence(rows, model, "doc_id", "text", "lang", "source"), model.languages, Scratch(spark, "t")).collect()
    assert len(got) == 3 and {r.language for r in got} == {"und"}
    assert L.fuse(L.text_evidence(empty, model, "doc_id", "text", "lang", "source"), model.languages, Scratch(spark, "t")).count() == 0
    pages = spark.createDataFrame([(1, None, None, 1)], "page_id long, url string, html string, likely int")
    assert L.fuse(L.page_evidence(pages, model), model.languages, Scratch(spark, "t")).where(F.col("language") == "und").count() == 1
