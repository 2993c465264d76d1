"""Source trees, corpora, reports and extractors."""

import ast
import hashlib

import pytest
from pyspark.sql import functions as F

from tracewell.plans import code_queries as Q
from tracewell.sources import python_code as C
from tracewell.sources import reports, trees


def test_scopes_and_package_folder(spark):
    paths = ["a/b.py", "tests/x.py", "a/test_b.py", "a/b_test.py", "build/c.py", "latest/d.py", "a/__init__.py", "a/b/__init__.py"]
    df = spark.createDataFrame([("i", p) for p in paths], "impl string, path string")
    assert [r.path for r in df.where(trees.in_repo_scope(F.col("path"))).collect()] == ["a/b.py", "latest/d.py", "a/__init__.py", "a/b/__init__.py"]
    assert "latest/d.py" not in [r.path for r in df.where(trees.in_package_scope(F.col("path"))).collect()]
    assert trees.package_folder(df).first().folder == "a"
    assert trees.package_folder(df, "b").first().folder == "a/b"


def test_files_and_corpus(spark, tmp_path):
    (tmp_path / "t/pkg").mkdir(parents=True)
    (tmp_path / "t/pkg/m.py").write_text("x = 1\n")
    (tmp_path / "t/pkg/n.txt").write_text("no")
    assert [(r.path, r.text) for r in trees.files(spark, f"{tmp_path}/t", "i").collect()] == [("pkg/m.py", "x = 1\n")]
    (tmp_path / "c/items/html").mkdir(parents=True)
    (tmp_path / "c/items/html/one.bin").write_bytes(b"abc")
    (tmp_path / "c/items/html/two.bin").write_bytes(b"abd")
    sha = hashlib.sha256(b"abc").hexdigest()
    (tmp_path / "c/MANIFEST.tsv").write_text(f"bucket\titem_id\tsha256\nhtml\tone.bin\t{sha}\nhtml\ttwo.bin\t{sha}\nhtml\tgone.bin\t{sha}\n")
    items = trees.corpus(spark, f"{tmp_path}/c")
    assert {r.item_id: r.ok for r in items.collect()} == {"one.bin": True, "two.bin": False, "gone.bin": False}
    assert trees.checked(items.where("item_id = 'one.bin'")).count() == 1
    with pytest.raises(Exception, match="digest differs"):
        trees.checked(items).collect()


def test_packed_random_and_hard_workload(spark):
    blob = b"".join(len(x).to_bytes(4, "big") + x for x in (b"", b"abc", b"\0" * 9))
    found = trees.packed_items(spark.createDataFrame([(blob,)], "content binary")).collect()
    assert [bytes(r.payload) for r in found] == [b"", b"abc", b"\0" * 9]
    with pytest.raises(ValueError):
        list(trees.unpack(b"\0\0\0\5abc"))
    assert trees.random_items(spark, n=5).collect() == trees.random_items(spark, n=5).collect()
    made = trees.hard_workload(spark.createDataFrame([(1, "Größe über alles"), (2, "Größe über alles")], "text_id int, text string")).collect()
    payloads = [bytes(r.payload) for r in made]
    assert len(set(payloads)) == len(payloads) and min(map(len, payloads)) >= 4 and {r.text_id for r in made} == {1}
    assert trees.adversarial(spark).count() == 8
    cut = spark.createDataFrame([("aé😀b",)], "t string").select(*(trees.cut_utf8(F.col("t").cast("binary"), n).cast("string").alias(f"c{n}") for n in range(1, 9))).first()
    assert list(cut) == ["a", "a", "aé", "aé", "aé", "aé", "aé😀", "aé😀b"]


def test_reports(spark, tmp_path):
    path = tmp_path / "w.tsv"
    path.write_text("# note\nsignal\tcontract\texpected\tactual\tverdict\tevidence\ns\tC1\te\tshared=5 strict=3; strict=1\tMEASURED\tx\ns\tC2\te\tv=0.5\tPASS\ty\nshort\trow\n")
    rows = reports.witness(spark, str(path))
    assert rows.count() == 2
    assert reports.numbers(rows, ["shared", "strict"]).first()[2:] == (5.0, 3.0)
    assert reports.exit_code(rows) == 0 and reports.exit_code(rows.withColumn("verdict", F.lit("FAIL"))) == 1
    reports.write_signals(rows, f"{tmp_path}/out")
    assert reports.witness(spark, f"{tmp_path}/out").collect() == rows.collect()
    (tmp_path / "r.json").write_text('{"a": NaN, "b": 1}')
    assert reports.json_report(spark, f"{tmp_path}/r.json").first().b == 1
    (tmp_path / "d.tex").write_text("rate is 0.625 here")
    assert reports.shown_numbers(spark, f"{tmp_path}/d.tex", {"rate": r"rate is ([0-9.]+)", "none": "x([0-9])"}).collect() == [("rate", "0.625"), ("none", "")]
    units, depends, blocks = reports.plan(spark, '[units.U1]\nlayer = 0\nestimated_loc = 5\nblocks = ["U2"]\n[units.U2]\nlayer = 1\ndepends_on = ["U1"]\n')
    assert (units.count(), depends.count(), blocks.count()) == (2, 1, 1)
    entities, links = reports.links(spark, '[[features]]\nid = "F1"\n[[code]]\nid = "K1"\nfeatures = ["F1", "F9"]\n')
    assert entities.count() == 2 and {r.dst for r in links.collect()} == {"F1", "F9"}


def test_annotations():
    assert C.normalise_annotation("Optional[int]") == "int | None"
    assert C.normalise_annotation("Union[A,  B]") == "A | B"
    assert C.normalise_annotation("Dict[str, Optional[List[int]]]") == "Dict[str, List[int] | None]"
    assert C.normalise_annotation(None) is None


def test_views_of_a_file():
    rows = list(C.file_rows("m.py", "class K:\n def f(self, a, *, b=1):\n  if a:\n   return g(a)\ndef g(x):\n def inner():\n  return h(x)\n return inner()\n"))
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    assert {r["name"] for r in of("call_fn")} == {"m.K.f", "m.g"}
    assert {(r["a"], r["b"]) for r in of("call_edge")} == {("m.K.f", "g"), ("m.g", "h"), ("m.g", "inner")}
    assert {(r["a"], r["b"]) for r in of("name_call")} == {("f", "g"), ("inner", "h"), ("g", "inner")}
    assert {r["name"] for r in of("shape")} == {"m.K.f", "m.g", "m.g.inner"}
    shape = next(r for r in of("shape") if r["a"] == "f")["shape"]
    assert shape == {"n_pos": 2, "n_kw": 1, "n_def": 1, "va": False, "kw": False, "n_ann": 0}
    trace = next(r for r in of("trace") if r["name"] == "K.f")
    assert (trace["arity"], trace["cyc"], trace["depth"], trace["ret"], trace["tot"]) == (3, 2, 1, 1, 3)
    assert list(C.file_rows("b.py", "def (:"))[0]["kind"] == "error"
    assert C.skeleton(ast.parse("def f():\n if x:\n  return 1\n").body[0]) == ["If", "  Return"]


def test_signals_of_two_packages(spark):
    audit = {(r.impl, r.name): r.rule for r in Q.p3_import_audit(spark, "").collect()}
    assert audit["old", "numpy"] == "R5_third_party_kept" and audit["old", "pack"] == "R2_first_party_self" and audit["new", "os"] == "R1_stdlib"
    assert Q.q4_import_jaccard(spark, "").first().jaccard == 0.0
    verdicts = {(r.kind, r.name): r.verdict for r in Q.x18_x22_interfaces(spark, "").collect()}
    assert verdicts["symbol", "load"] == "renamed_args"
    assert verdicts["symbol", "Reader"] == "diverged"  # symbols don't follow relative imports
    assert verdicts["class", "Reader"] == "diverged"  # close() is gone
    matches = Q.j3_function_matches(spark, "").collect()
    assert len({r.i for r in matches}) == len({r.j for r in matches}) == len(matches) == 7
    literals = {r.kind: r.similarity for r in Q.x9_x12_literals(spark, "").collect()}
    assert literals["table"] == 1.0 and literals["float"] == 1.0 and literals["import"] == pytest.approx(2 / 5)
    names = {r.id: r.component for r in Q.x2_name_graph(spark, "").where("g = 'old'").collect()}
    assert names["helper_one"] == names["helper_two"] == "helper_one"


def test_envelope_intervals_and_validation(spark):
    rows = {(r.a, r.b): r for r in Q.q9_envelope(spark, "").collect()}
    assert rows["old", "new"].combined > 0.9 > 0.7 > rows["old", "other"].combined
    found = {r.signal: r for r in Q.q20_intervals(spark, "").collect()}
    assert set(found) == {"control_flow", "topology", "wl", "functions"} and all(r.n_resamples == 1000 and 0 <= r.lower <= r.upper <= 1 + 1e-9 for r in found.values())
    assert {r.name: r.agrees for r in Q.q21_validation(spark, "").collect()} == {"old.return": True, "edges.old": True, "edges.new": False}


def test_resamples_differ_in_set_and_multiset_semantics(spark):
    from tracewell.operators import bootstrap as BS

    drawn = spark.createDataFrame([(0, "a", "f", 2), (0, "b", "f", 1)], "rep int, side string, path string, weight int")
    hist = spark.createDataFrame([("a", "f", "x", 1), ("a", "f", "y", 1), ("b", "f", "x", 2)], "side string, path string, key string, cnt long")
    assert BS.histogram_cosine(hist, drawn).first().metric == pytest.approx(1 / 2**0.5)
    nodes = spark.createDataFrame([(s, "f", i) for s in "ab" for i in "xy"], "side string, path string, id string")
    calls = spark.createDataFrame([(s, "f", "x", "y") for s in "ab"], "side string, path string, src string, dst string")
    assert BS.topology_similarity(nodes, calls, drawn).first().metric == 1.0
    assert BS.wl_cosine(nodes, calls, drawn).first().metric == pytest.approx(1.0)
