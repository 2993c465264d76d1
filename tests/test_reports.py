"""Operators that no registered query reaches: detectors, written reports, mails and roll-ups."""

import email
import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators import behaviour as B
from tracewell.operators import matching as M
from tracewell.plans import match_queries
from tracewell.sources import reports, trees


def test_detectors_run_over_items_and_errors_are_labels(spark):
    items = spark.createDataFrame([("w", "b", "1", bytearray(b"abc")), ("w", "b", "2", bytearray(b"\xff")), ("w", "b", "__meta", bytearray(b"x"))], "workload string, bucket string, item string, payload binary")
    decode = lambda payload: (payload.decode() and "ascii", 1.0)
    found = {r.item: (r.impl, r.enc, r.conf) for r in B.detect(items, "one", decode).collect()}
    assert found == {"1": ("one", "ascii", 1.0), "2": ("one", "ERR:UnicodeDecodeError", None), "__meta": ("one", "ascii", 1.0)}
    both = B.detect(items, "one", decode).unionByName(B.detect(items, "two", lambda p: ("latin-1", 0.5)))
    assert {(r.item, r.enc_a, r.enc_b) for r in B.paired(both, "one", "two").collect()} == {("1", "ascii", "latin-1"), ("2", "ERR:UnicodeDecodeError", "latin-1")}


def test_merged_reports_and_pivots(spark):
    static = spark.createDataFrame([("s1", "PASS"), ("s2", "DELEGATED")], "signal string, verdict string")
    assert {tuple(r) for r in reports.merged(static, spark.createDataFrame([("s2", "MEASURED")], "signal string, verdict string")).collect()} == {("s1", "PASS"), ("s2", "MEASURED")}
    rows = spark.createDataFrame([("s1", "p", 0.5), ("s1", "q", 0.7), ("s2", "p", 1.0)], "signal string, pair string, value double")
    assert {tuple(r) for r in reports.comparison(rows, ["p", "q"]).collect()} == {("s1", 0.5, 0.7), ("s2", 1.0, None)}


def test_written_files(spark, tmp_path):
    audit = spark.createDataFrame([("b", "old", "R1"), ("A", "new", "R2"), ("a", "old", "R3")], "name string, impl string, rule string")
    reports.write_imports(audit, f"{tmp_path}/imports")
    lines = next((tmp_path / "imports").glob("part-*")).read_text().splitlines()
    assert lines[0] == "name\timpl\trule" and lines[1:] == ["A\tnew\tR2", "a\told\tR3", "b\told\tR1"]
    reports.write_json(audit, f"{tmp_path}/json")
    found = [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text().splitlines()]
    assert {x["rule"] for x in found} == {"R1", "R2", "R3"}


def test_agreement_report_as_json(spark):
    rows = [("one", "w", "x", "1", "utf-8", 0.9), ("two", "w", "x", "1", "UTF-8", 0.9), ("one", "w", "y", "2", "ascii", 0.9), ("two", "w", "y", "2", "cp1252", 0.4)]
    pairs = B.paired(spark.createDataFrame(rows, "impl string, workload string, bucket string, item string, enc string, conf double"), "one", "two")
    report = spark.createDataFrame([(None, 2, 1), ("x", 1, 1), ("y", 1, 0)], "bucket string, n int, agree int")
    samples = pairs.withColumn("normalised_agree", F.lower("enc_a") == F.lower("enc_b")).where("not normalised_agree")
    found = json.loads(reports.agreement_json(report, samples).first().value)
    assert found["aggregate"]["n"] == 2 and found["per_bucket"]["x"]["agree"] == 1
    assert [s["enc_b"] for s in found["per_bucket"]["y"]["samples"]] == ["cp1252"]


def test_a_mail_of_one_part(spark):
    text = spark.range(1).select(trees.mime(F.lit("Grüße"), "utf-8").alias("x")).first().x
    mail = email.message_from_bytes(text.encode())
    assert mail.get_content_charset() == "utf-8" and mail.get_payload(decode=True).decode() == "Grüße\r\n"


def test_match_rollup(spark):
    matched = spark.createDataFrame([(0.1,), (0.3,)], "distance double")
    assert M.match_rollup(matched, 5, 3) == {"similarity": pytest.approx(0.8), "matched": 2, "unmatched_a": 3, "unmatched_b": 1}
    assert M.match_rollup(matched.limit(0), 1, 1)["similarity"] == 0.0


def test_signals_of_two_folders(spark, tmp_path):
    import ast
    from collections import Counter

    from tracewell.plans import code_queries, pair
    from tracewell.sources import python_code

    for side, files in (("a", code_queries.OLD), ("b", code_queries.NEW)):
        for path, text in files.items():
            (tmp_path / side / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / side / path).write_text(text)
        (tmp_path / side / "tests").mkdir()
        (tmp_path / side / "tests" / "test_x.py").write_text("import left_out\n")
    rows = {r.contract: r for r in pair.signals(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()}
    assert list(rows) == ["AUX1", "C06a", "C06a'", "C06b", "C06c", "C06d", "C06f"]
    # util.py alone is the same in both
    assert rows["AUX1"].actual == "matches=1 files_a=4 files_b=3" and rows["AUX1"].verdict == "FAIL"
    assert rows["C06b"].actual == "jaccard=0.000 shared=0" and rows["C06b"].evidence == "a: numpy; b: requests"

    def control(files):
        out = Counter()
        for text in files.values():
            try:
                out.update(type(n).__name__ for n in ast.walk(ast.parse(text)) if type(n).__name__ in python_code.CONTROL)
            except SyntaxError:
                pass
        return out

    x, y = control(code_queries.OLD), control(code_queries.NEW)
    cosine = sum(x[k] * y[k] for k in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    assert rows["C06c"].actual == f"cosine={cosine:.3f} total_a={x.total()} total_b={y.total()}"
    top = sorted(set(x) | set(y), key=lambda k: (-(x[k] + y[k]), k))[:6]
    assert rows["C06c"].evidence == "; ".join(f"{k}: a={x[k]} b={y[k]}" for k in top)
    assert rows["C06d"].actual.startswith("shared=2 ") and "symbol load=renamed_args" in rows["C06d"].evidence
    assert "matched_pairs=7 " in rows["C06f"].actual and rows["C06a"].evidence.count("differ=") == 8 and rows["C06a'"].evidence.count("round ") == 5


def test_every_source_is_matched_with_the_next_both_ways(spark):
    rows = match_queries.descriptors(spark, "/root/testdata/sf0.001")
    names = sorted(r.source for r in rows.select("source").distinct().collect() if r.source is not None)
    left, right = match_queries._all_pairs(rows)
    ring = set(zip(names, names[1:] + names[:1]))
    assert {r.pair for r in left.select("pair").distinct().collect()} == {f"{a}>{b}" for a, b in ring | {(b, a) for a, b in ring}}
    assert {r.id for r in left.collect()} == {r.id for r in rows.where("source is not null").collect()} == {r.id for r in right.collect()}
