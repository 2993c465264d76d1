"""The signal table of two source trees: one row a signal, as reports.write_signals writes it."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.columns import rel_diff, safe_div
from tracewell.operators import graph as G
from tracewell.operators import provenance as P
from tracewell.operators import similarity as S
from tracewell.operators.bootstrap import TOPOLOGY
from tracewell.operators.lineage import cut
from tracewell.plans.code_queries import call_graph, function_matches
from tracewell.sources import python_code as C
from tracewell.sources import trees
from tracewell.sources.reports import SIGNAL


def _row(values: DataFrame, signal: str, contract: str, expected: str, actual: Column, evidence: Column, verdict: Column | None = None) -> DataFrame:
    return values.select(F.lit(signal).alias("signal"), F.lit(contract).alias("contract"), F.lit(expected).alias("expected"), actual.alias("actual"), (verdict if verdict is not None else F.lit("MEASURED")).alias("verdict"), evidence.alias("evidence"))


def _sides(spark: SparkSession, rows: DataFrame, side: str, columns: list[str]) -> DataFrame:
    """One row with each column of both sides; zeros for a side without a row."""
    both = spark.createDataFrame([("a",), ("b",)], f"{side} string").join(rows, side, "left").na.fill(0)
    return both.agg(*(F.max(F.when(F.col(side) == s, F.col(c))).alias(f"{c}_{s}") for c in columns for s in "ab"))


def graph_signals(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Topology (C06a), and label multisets (C06a') over all rounds and for each."""
    nodes, edges = (cut(x) for x in call_graph(found))
    t = _sides(spark, G.topology(nodes, edges), "g", TOPOLOGY)
    differ = {c: rel_diff(F.col(f"{c}_a").cast("double"), F.col(f"{c}_b").cast("double")) for c in TOPOLOGY}
    similarity = 1 - sum(differ.values(), F.lit(0.0)) / len(TOPOLOGY)
    parts = [F.format_string(f"{c}: a=%.3f b=%.3f differ=%.3f", F.col(f"{c}_a").cast("double"), F.col(f"{c}_b").cast("double"), d) for c, d in differ.items()]
    shape = F.format_string("similarity=%.3f nodes_a=%d nodes_b=%d edges_a=%d edges_b=%d", similarity, *(F.col(f"{c}_{s}").cast("long") for c in ("nodes", "edges") for s in "ab"))
    out = _row(t, "call_graph_topology", "C06a", "similarity of eight measures of the call graphs", shape, F.concat_ws("; ", *parts))
    counts = G.wl_labels(nodes, edges, rounds=4).groupBy("iter", "label").agg(*(F.count_if(F.col("g") == s).cast("double").alias(s) for s in "ab"))
    sums = cut(counts.groupBy("iter").agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("b") ** 2).alias("bb")))
    cosine = lambda dot, aa, bb: safe_div(dot, F.sqrt(aa) * F.sqrt(bb))
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("iter", cosine(F.col("dot"), F.col("aa"), F.col("bb")).alias("c")))), lambda x: F.format_string("round %d: %.3f", x["iter"], x["c"])), "; ")
    labels = sums.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("dot", "aa", "bb")), each.alias("each"))
    return out.unionByName(_row(labels, "call_graph_wl_kernel", "C06a'", "cosine of Weisfeiler-Lehman label multisets, four rounds", F.format_string("similarity=%.3f", cosine(F.col("dot"), F.col("aa"), F.col("bb"))), F.col("each")))


def control_flow_signal(spark: SparkSession, found: DataFrame) -> DataFrame:
    """C06c, with the six commonest kinds of both sides."""
    hist = cut(C.view(found, "control").groupBy(F.col("impl").alias("side"), F.col("name").alias("key")).agg(F.sum("n").alias("cnt")))
    totals = _sides(spark, hist.groupBy("side").agg(F.sum("cnt").alias("total")), "side", ["total"])
    sides = spark.createDataFrame([("a",), ("b",)], "side string")
    terms = S.top_terms(hist, "a", "b", 6).select(F.struct((-(F.col("cnt_a") + F.col("cnt_b"))).alias("o"), "key", "cnt_a", "cnt_b").alias("t")).agg(F.array_sort(F.collect_list("t")).alias("t"))
    terms = terms.select(F.array_join(F.transform("t", lambda x: F.format_string("%s: a=%d b=%d", x["key"], x["cnt_a"], x["cnt_b"])), "; ").alias("evidence"))
    row = S.cosine(hist, sides).select("cosine").join(F.broadcast(totals)).join(F.broadcast(terms))  # one row each
    return _row(row, "control_flow_histogram", "C06c", "cosine of control-flow histograms", F.format_string("cosine=%.3f total_a=%d total_b=%d", "cosine", F.col("total_a").cast("long"), F.col("total_b").cast("long")), F.col("evidence"))


def function_signal(spark: SparkSession, found: DataFrame) -> DataFrame:
    """C06f: the roll-up of one-to-one matches."""
    counts = _sides(spark, C.view(found, "shape").groupBy("impl").agg(F.count(F.lit(1)).alias("n")), "impl", ["n"])
    last = lambda c: F.element_at(F.split(c, r"[:.]"), -1)
    matched = function_matches(found, "a", "b").agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.avg("distance"), F.lit(1.0)).alias("d"), F.coalesce(F.avg((last("i") == last("j")).cast("int")), F.lit(0.0)).alias("named"))
    text = "per_function_similarity=%.3f matched_pairs=%d functions_a=%d functions_b=%d unmatched_a=%d unmatched_b=%d"
    m, a, b = (F.col(c).cast("long") for c in ("m", "n_a", "n_b"))
    actual = F.format_string(text, F.greatest(F.lit(0.0), 1 - F.col("d")), m, a, b, a - m, b - m)
    return _row(matched.join(F.broadcast(counts)), "per_function_ast_shape", "C06f", "similarity of functions matched by signature and degrees, and the unmatched", actual, F.format_string("mean_pair_distance=%.3f; same_name_share=%.3f", "d", "named"))


def interface_signal(files: DataFrame, packages: DataFrame) -> DataFrame:
    """C06d: verdicts of shared exported symbols, and of classes by their public methods."""
    found = cut(C.interfaces(files.join(F.broadcast(packages), "impl")))
    a, b = (C.view(found, "symbol").where(F.col("impl") == s).select("method", F.col("sig").alias(f"s{s}")) for s in "ab")
    shared = a.join(b, "method").select(F.lit("symbol").alias("kind"), F.col("method").alias("name"), P.signature_verdict(F.col("sa"), F.col("sb"), C.SIGNATURE_SHAPE).alias("v"))
    methods = [C.view(found, "method").where(F.col("impl") == s).select("cls", "method", "d") for s in "ab"]
    rows = shared.unionByName(P.class_verdicts(*methods, C.METHOD_SHAPE).select(F.lit("class").alias("kind"), F.col("cls").alias("name"), F.col("verdict").alias("v")))
    symbol = F.col("kind") == "symbol"
    count = lambda v: F.count_if(symbol & (F.col("v") == v))
    evidence = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.concat_ws(" ", "kind", "name"), "v"))), "; ")
    return _row(rows.agg(F.format_string("shared=%d strict=%d renamed_args=%d diverged=%d", F.count_if(symbol), *map(count, ("strict", "renamed_args", "diverged"))).alias("x"), evidence.alias("e")), "public_api_signature_equivalence", "C06d", "verdicts of the exported symbols that both have", F.col("x"), F.col("e"))


def signals(spark: SparkSession, folder_a: str, folder_b: str, package_a: str | None = None, package_b: str | None = None) -> DataFrame:
    """The signals of two folders of Python sources, which any executor can read: columns SIGNAL, a row each. Behaviour (C06e) needs detectors: reports.merged adds its rows.

    A tree's package is its shortest folder with an __init__.py, or the shortest of the given name. Files are parsed once, and that written; everything else reads the rows.
    """
    listing = trees.files(spark, folder_a, "a").unionByName(trees.files(spark, folder_b, "b")).select("impl", "path", "text")
    folders = cut(trees.package_folder(listing.where("impl = 'a'"), package_a).unionByName(trees.package_folder(listing.where("impl = 'b'"), package_b)))
    packages = folders.select("impl", F.element_at(F.split("folder", "/"), -1).alias("package"))
    files = cut(listing.where(trees.in_repo_scope(F.col("path"))))
    found = cut(C.extract(files))
    sides = spark.createDataFrame([("a",), ("b",)], "side string")
    carried = P.literal_carryover(files.select(F.col("impl").alias("side"), "text"), sides)
    out = _row(carried, "literal_source_carryover", "AUX1", "no text that both trees hold", F.format_string("matches=%d files_a=%d files_b=%d", *(F.col(c).cast("long") for c in ("shared", "n_a", "n_b"))), F.col("evidence"), F.col("verdict"))
    kept = C.classify_imports(C.view(found, "import"), files.select("impl", "path"), packages, sorted(sys.stdlib_module_names)).where("rule = 'R5_third_party_kept'")
    names = cut(kept.select(F.col("impl").alias("side"), F.col("name").alias("key")).distinct().withColumn("cnt", F.lit(1)))
    listed = names.agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("key")))), ",").alias(f"list_{s}") for s in "ab"))
    imports = S.jaccard(names, sides, both_empty=0.0).join(F.broadcast(listed))  # one row each
    out = out.unionByName(graph_signals(spark, found))
    actual = F.format_string("jaccard=%.3f shared=%d", "jaccard", F.col("shared").cast("long"))
    out = out.unionByName(_row(imports, "import_edge_set", "C06b", "Jaccard of third-party imports", actual, F.format_string("a: %s; b: %s", "list_a", "list_b")))
    out = out.unionByName(control_flow_signal(spark, found)).unionByName(interface_signal(files, packages)).unionByName(function_signal(spark, found))
    return out.select(*SIGNAL)
