"""Signals of two small packages, written here: every extractor and composite signal on source code. SQL has no parser, so tests hold these against known values."""

from __future__ import annotations

import hashlib
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import QUIRK_STOP, degree_bucket, is_distinctive, is_message, map_cosine, message, pair_distance, shingles
from tracewell.operators import bootstrap as BS
from tracewell.operators import graph as G
from tracewell.operators import matching as M
from tracewell.operators import provenance as P
from tracewell.operators import similarity as S
from tracewell.operators import statistics as T
from tracewell.operators.lineage import cut
from tracewell.plans.registry import query
from tracewell.sources import python_code as C
from tracewell.sources import trees

OLD = {
    "pack/__init__.py": '"""A pack."""\nfrom pack.core import Reader, load\n__all__ = ["Reader", "load", "gone"]\n',
    "pack/core.py": '''import os, json, pack.util
import numpy as np
LIMITS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]
THRESHOLD = 0.125

class Reader:
    """Reads every record."""
    chunk_size = 10
    def __init__(self, path, mode="r"):
        self.path = path
    def read_all(self, limit: "Optional[int]" = None) -> "Optional[str]":
        out = []
        for line in self.lines():
            if limit and len(out) > limit:
                raise ValueError("too many records in file")
            out.append(line)
        return out
    def lines(self):
        with open(self.path) as f:
            for line in f:
                yield line
    def close(self):
        pass

def load(path, strict=False):
    # distinctive comment about loading
    try:
        return Reader(path).read_all()
    except ValueError:
        if strict:
            raise
        return helper_value(path)

def helper_value(p):
    total = 0
    while total < 10 and p:
        total += len(p)
    return total
''',
    "pack/util.py": "import sys\ndef helper_one(a, b):\n    return a + b if a else helper_two(b)\ndef helper_two(b):\n    return helper_one(b, 1)\n",
    "broken.py": "def (:\n",
}
NEW = {
    "pack/__init__.py": '"""A pack."""\nfrom .core import Reader\nfrom pack.core import load\n__all__ = ["Reader", "load"]\n',
    "pack/core.py": '''import os, requests
LIMITS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]
THRESHOLD = 0.125

class Reader:
    """Reads every record again."""
    chunk_size = 10
    buffer_size = 4
    def __init__(self, path, mode="r"):
        self.path = path
    def read_all(self, maximum: "int | None" = None) -> "str | None":
        out = []
        for line in self.lines():
            if maximum and len(out) > maximum:
                raise ValueError("too many records in file")
            out.append(line)
        return out
    def lines(self):
        with open(self.path) as f:
            yield from f

def load(file, strict=False):
    # distinctive comment about loading
    try:
        return Reader(file).read_all()
    except ValueError:
        if strict:
            raise
        return helper_value(file)

def helper_value(p):
    total = 0
    while total < 10 and p:
        total += len(p)
    return total
''',
    "pack/util.py": "import sys\ndef helper_one(a, b):\n    return a + b if a else helper_two(b)\ndef helper_two(b):\n    return helper_one(b, 1)\n",
}

OTHER = {
    "pack/__init__.py": "from pack.board import Board\n__all__ = ['Board']\n",
    "pack/board.py": '''import random
class Board:
    """Keeps squares of a game."""
    def __init__(self, width=8):
        self.squares = [[None] * width for _ in range(width)]
    def move_piece(self, origin, target):
        piece = self.squares[origin[0]][origin[1]]
        assert piece is not None, "there is no piece to move"
        self.squares[target[0]][target[1]] = piece
        return {k: v for k, v in zip("ab", target)}
    def shuffle_all(self):
        random.shuffle(self.squares)
        return [s for row in self.squares for s in row if s]
''',
}
#: Pairs of implementations, and whether the second derives from the first.
PAIRS = [("old", "new", "POS"), ("old", "other", "NEG"), ("new", "other", "NEG")]


def sources(spark: SparkSession, with_other: bool = False) -> DataFrame:
    sides = [("old", OLD), ("new", NEW), *([("other", OTHER)] if with_other else [])]
    rows = [(impl, p, t) for impl, files in sides for p, t in files.items()]
    return spark.createDataFrame(rows, "impl string, path string, text string").where(trees.in_repo_scope(F.col("path")))


def features(spark: SparkSession, with_other: bool = False) -> DataFrame:
    return C.extract(sources(spark, with_other))


def _set(rows: DataFrame, column: str = "name") -> DataFrame:
    return rows.select(F.col("impl").alias("side"), F.col(column).cast("string").alias("key")).distinct().withColumn("cnt", F.lit(1))


def call_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    return G.merge(C.view(found, "call_fn").select(F.col("impl").alias("g"), F.col("name").alias("id")), C.view(found, "call_edge").select(F.col("impl").alias("g"), F.col("a").alias("src"), F.col("b").alias("dst")))


def name_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions by bare name; calls count where the package defines the callee."""
    nodes = C.view(found, "name_def").select(F.col("impl").alias("g"), F.col("name").alias("id")).distinct()
    calls = C.view(found, "name_call").select(F.col("impl").alias("g"), F.col("a").alias("src"), F.col("b").alias("dst"))
    return nodes, calls.join(nodes.withColumnRenamed("id", "dst"), ["g", "dst"], "left_semi").select("g", "src", "dst").distinct()


@query()
def x1_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_graph(features(spark))[1]


@query()
def x2_name_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strong_components(*name_graph(features(spark)))


@query()
def x3_function_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.view(features(spark), "shape")
    return found.select("impl", "name", "shape.*", "depth", F.col("n").alias("n_stmts"), F.to_json("h").alias("body"))


@query()
def x6_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-flow histograms, their shares, and the cosine of the two sides."""
    hist = C.view(features(spark), "control").groupBy(F.col("impl").alias("side"), F.col("name").alias("key")).agg(F.sum("n").alias("cnt"))
    return S.shares(hist).join(S.cosine(hist).select("cosine"))


@query()
def x8_stream_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = C.view(features(spark), "stream").select("impl", F.explode(shingles(F.col("items"), 5)).alias("gram"))
    return S.overlap(S.histogram(streams, "impl", "gram"))


@query()
def x9_x12_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of data tables; Jaccard of floats, messages and imports (two empty sets are alike)."""
    found = cut(features(spark))
    texts = C.view(found, "string").where(is_message(F.col("name"))).withColumn("name", message(F.col("name")))
    sets = {"float": _set(C.view(found, "float"), "x"), "message": _set(texts), "import": _set(C.view(found, "import").where("name <> 'pack'"))}
    sides = found.select(F.col("impl").alias("side"))
    out = S.overlap(S.histogram(C.view(found, "table"), "impl", "name"), sides).select(F.lit("table").alias("kind"), "a", "b", F.col("overlap").alias("similarity"))
    for kind, rows in sets.items():
        out = out.unionByName(S.jaccard(rows, sides, both_empty=1.0).select(F.lit(kind).alias("kind"), "a", "b", F.col("jaccard").alias("similarity")))
    return out


@query()
def x14_x17_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of identifiers, distinctive ones, docstring and comment words, and public names."""
    found = cut(features(spark))
    sides = found.select(F.col("impl").alias("side"))
    idents = _set(C.view(found, "ident"))
    text_words = lambda kind: _set(C.view(found, kind).select("impl", F.explode(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]{4,})"), 1)).alias("name")).where(~F.col("name").isin(QUIRK_STOP)))
    out = None
    for kind, rows in {"ident": idents, "distinctive": idents.where(is_distinctive(F.col("key"))), "doc": text_words("doc"), "comment": text_words("comment"), "api": _set(C.view(found, "api"))}.items():
        part = S.jaccard(rows, sides, both_empty=1.0).select(F.lit(kind).alias("kind"), "a", "b", "shared", "jaccard")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def p3_import_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each import's origin by the first rule that holds, and whether it counts."""
    files = sources(spark)
    packages = spark.createDataFrame([("old", "pack"), ("new", "pack")], "impl string, package string")
    audit = C.classify_imports(C.view(C.extract(files), "import"), files.select("impl", "path"), packages, sorted(sys.stdlib_module_names))
    return audit.withColumn("kept", F.when(F.col("rule") == "R5_third_party_kept", "yes").otherwise("no"))


@query()
def q4_import_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = p3_import_audit(spark, sf_dir)
    return S.jaccard(_set(kept.where("kept = 'yes'")), kept.select(F.col("impl").alias("side")), both_empty=0.0)


@query()
def x18_x22_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of exported symbols and, by class, of public methods."""
    found = cut(C.interfaces(sources(spark).withColumn("package", F.lit("pack"))))
    symbols = [C.view(found, "symbol").where(F.col("impl") == i).select("method", F.col("sig").alias(x)) for i, x in (("old", "sa"), ("new", "sb"))]
    shared = symbols[0].join(symbols[1], "method").select(F.lit("symbol").alias("kind"), F.col("method").alias("name"), P.signature_verdict(F.col("sa"), F.col("sb"), C.SIGNATURE_SHAPE).alias("verdict"))
    methods = [C.view(found, "method").where(F.col("impl") == i).select("cls", "method", "d") for i in ("old", "new")]
    classes = P.class_verdicts(*methods, C.METHOD_SHAPE).select(F.lit("class").alias("kind"), F.col("cls").alias("name"), "verdict")
    return shared.unionByName(classes)


@query()
def x23_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict matches of the old functions among the new ones."""
    found = C.view(features(spark), "trace").select("impl", F.concat_ws(":", "path", "name").alias("id"), "path", "pos", *M.DESCRIPTOR)
    ordered = found.withColumn("order", F.row_number().over(Window.partitionBy("impl").orderBy("path", "pos")))
    a, b = (ordered.where(F.col("impl") == i).select(F.lit("old>new").alias("pair"), "id", "order", *M.DESCRIPTOR) for i in ("old", "new"))
    return M.verdict(M.strict_best(a, b)).select("id_a", "id_b", F.round("cosine", 9).alias("cosine"), "verdict", "band")


def function_matches(found: DataFrame, first: str, second: str) -> DataFrame:
    """One-to-one matches of functions of equal signature shape and fan-in and fan-out buckets, nearest first: (pair, i, j, distance)."""
    degrees = G.degrees(*call_graph(found)).select(F.col("g").alias("impl"), F.col("id").alias("name"), "n_in", "n_out")
    f = C.view(found, "shape").join(degrees, ["impl", "name"], "left")
    bucket = lambda c: degree_bucket(F.coalesce(c, F.lit(0)))
    f = f.select("impl", F.concat_ws(":", "path", "name").alias("id"), F.struct("shape", bucket("n_in").alias("fi"), bucket("n_out").alias("fo")).alias("key"), "h", "depth", "n")
    a, b = (f.where(F.col("impl") == i).select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "h", "depth", "n"))) for i, x in ((first, "a"), (second, "b")))
    distance = pair_distance(map_cosine(F.col("h_a"), F.col("h_b")), F.col("depth_a"), F.col("depth_b"), F.col("n_a"), F.col("n_b"))
    candidates = a.join(b, "key").select(F.lit(f"{first}>{second}").alias("pair"), F.col("id_a").alias("i"), F.col("id_b").alias("j"), distance.alias("distance"))
    return M.mutual_greedy(candidates)


@query()
def j3_function_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_matches(cut(features(spark)), "old", "new").withColumn("distance", F.round("distance", 9))


@query()
def x24_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    import ast

    rows = [(impl, f.name, C.skeleton(f)) for impl, files in (("old", OLD), ("new", NEW)) for f in ast.walk(ast.parse(files["pack/core.py"])) if isinstance(f, ast.FunctionDef)]
    return spark.createDataFrame(rows, "impl string, name string, skeleton array<string>")


_HARD_TEXTS = [(1, "Größe und Maß über Straßen"), (2, "Съешь ещё этих мягких булок"), (3, "いろはにほへと ちりぬるを"), (4, "plain ascii text")]


def _hard_sql() -> str:
    """The workload by a plain loop, as values: SQL has no codecs."""
    cuts = {t.encode(c, "ignore")[:n] for _, t in _HARD_TEXTS for c in trees.CHARSETS for n in trees.LENGTHS}
    rows = [(hashlib.sha256(x).hexdigest(), x) for x in cuts if len(x) >= 4] + [(f"adv_{i:02d}", x) for i, x in enumerate(trees.ADVERSARIAL)]
    return f"SELECT * FROM (VALUES {', '.join(f"('{k}', '{x.hex().upper()}')" for k, x in sorted(rows))}) v(item_id, payload)"


@query(_hard_sql(), python=True)
def s9_hard_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame(_HARD_TEXTS, "text_id int, text string")
    made = trees.hard_workload(texts).select(F.col("digest").alias("item_id"), "payload")
    return made.unionByName(trees.adversarial(spark)).select("item_id", F.hex("payload").alias("payload"))


def measures(spark: SparkSession) -> DataFrame:
    """(a, b, label, measure, value): every static measure of every pair of implementations, as rows."""
    found = cut(features(spark, True))
    sides = found.select(F.col("impl").alias("side")).distinct()
    view = lambda k: C.view(found, k)
    counted = lambda k: view(k).groupBy(F.col("impl").alias("side"), F.col("name").alias("key")).agg(F.sum("n").alias("cnt"))
    streams = S.histogram(view("stream").select("impl", F.explode(shingles(F.col("items"), 5)).alias("gram")), "impl", "gram")
    graph = name_graph(found)
    labels = G.wl_labels(*graph, rounds=4, successors_only=True).withColumn("key", F.concat_ws(":", "iter", "label"))
    topology = G.topology(*graph).withColumn("scc_ratio", F.col("sccs") / F.col("nodes"))
    shape = view("pilot_fn").select("impl", F.struct("shape.n_pos", "shape.n_kw", "shape.va", "shape.kw").alias("sig"), F.concat_ws(":", "path", "name").alias("id"), "h", F.struct("path", "pos").alias("at")).withColumn("order", F.row_number().over(Window.partitionBy("impl").orderBy("at"))).drop("at")
    pairs = spark.createDataFrame(PAIRS, "a string, b string, label string")
    left, right = (shape.join(pairs.select(F.col(x).alias("impl"), F.concat_ws(">", "a", "b").alias("pair")), "impl") for x in "ab")
    matched = M.in_order_greedy(left, right).groupBy("pair").agg(F.avg("cosine").alias("value"))
    matched = pairs.withColumn("pair", F.concat_ws(">", "a", "b")).join(matched, "pair", "left").select("a", "b", F.coalesce("value", F.lit(0.0)).alias("value"))
    idents = _set(view("ident"))
    messages = _set(view("string").where(is_message(F.col("name"))).withColumn("name", message(F.col("name"))))
    text_words = lambda kind: _set(view(kind).select("impl", F.explode(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]{4,})"), 1)).alias("name")).where(~F.col("name").isin(QUIRK_STOP)))
    sets = {"imports": _set(view("import").where("name <> 'pack'")), "floats": _set(view("float"), "x"), "messages": messages, "identifiers": idents, "distinctive": idents.where(is_distinctive(F.col("key"))), "doc_words": text_words("doc"), "comment_words": text_words("comment")}
    rows = {
        "shingles": S.overlap(streams, sides).withColumnRenamed("overlap", "value"),
        "control_flow": S.cosine(counted("control"), sides).withColumnRenamed("cosine", "value"),
        "node_types": S.cosine(counted("node"), sides).withColumnRenamed("cosine", "value"),
        "topology": S.feature_similarity(topology, "g", ["density", "scc_ratio", "mean_in", "max_in", "mean_out", "max_out"]).withColumnRenamed("similarity", "value"),
        "wl": S.cosine(S.histogram(labels, "g", "key"), sides).withColumnRenamed("cosine", "value"),
        "functions": matched,
        "tables": S.overlap(S.histogram(view("table"), "impl", "name"), sides).withColumnRenamed("overlap", "value"),
    } | {k: S.jaccard(v, sides, both_empty=1.0).select("a", "b", F.col("jaccard").alias("value")) for k, v in sets.items()}
    out = None
    for name, df in rows.items():
        part = df.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.lit(name).alias("measure"), "value")
        out = part if out is None else out.unionByName(part)
    ordered = pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    return ordered.join(out, ["lo", "hi"]).select("a", "b", "label", "measure", "value")


@query()
def q9_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six structural measures of each pair in order: smallest, second, upper median, largest, and their mean."""
    six = ["shingles", "control_flow", "node_types", "topology", "wl", "functions"]
    wide = measures(spark).groupBy("a", "b", "label").pivot("measure", six).agg(F.first("value"))
    lo, second, median, hi = S.envelope(*map(F.col, six))
    return wide.select("a", "b", "label", *six, lo.alias("lo"), second.alias("second"), median.alias("upper_median"), hi.alias("hi"), S.nan_mean(*map(F.col, six)).alias("combined"))


@query()
def q14_measure_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each measure tells derived pairs from independent ones."""
    return T.auc(measures(spark), ["measure"], "value", F.col("label") == "POS")


@query()
def q20_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of four signals over resampled files (and matches) of the two packages."""
    found = cut(features(spark)).withColumn("side", F.when(F.col("impl") == "old", "a").otherwise("b"))
    paths = [sorted(p for p in files if not p.startswith("broken")) for files in (OLD, NEW)]
    drawn = cut(BS.resamples(spark, *paths))
    control = C.view(found, "control").select("side", "path", F.col("name").alias("key"), F.col("n").alias("cnt"))
    graph = C.view(found, "call_fn").select("side", "path", F.col("name").alias("id")), C.view(found, "call_edge").select("side", "path", F.col("a").alias("src"), F.col("b").alias("dst"))
    numbered = j3_function_matches(spark, sf_dir).select((F.row_number().over(Window.partitionBy("pair").orderBy("i", "j")) - 1).alias("idx"), "distance")
    out = BS.interval(BS.histogram_cosine(control, drawn), "control_flow")
    for signal, metrics in (("topology", BS.topology_similarity(*graph, drawn)), ("wl", BS.wl_cosine(*graph, drawn)), ("functions", BS.mean_similarity(numbered))):
        out = out.unionByName(BS.interval(metrics, signal))
    return out


@query()
def q21_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed numbers of the two packages against those expected; one is wrong on purpose, so that a disagreement shows."""
    control = x6_control_flow(spark, sf_dir).where("side = 'old' and key = 'Return'").select(F.lit("old.return").alias("name"), F.col("cnt").cast("string").alias("value"))
    edges = x1_call_graph(spark, sf_dir).groupBy("g").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.concat(F.lit("edges."), "g").alias("name"), "value")
    expected = [("old.return", "6"), ("edges.old", "11"), ("edges.new", "0")]
    return P.reconcile(spark.createDataFrame(expected, "name string, value string"), control.unionByName(edges))
