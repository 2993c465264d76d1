"""Carried-over text, residual features, interface comparison, reconciliation and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import normalised_text
from tracewell.operators.similarity import first_n, side_pairs


def literal_carryover(files: DataFrame, sides: DataFrame | None = None, evidence: int = 5) -> DataFrame:
    """(a, b, n_a, n_b, shared, evidence, verdict) of files(side, text): distinct normalised texts that both sides have."""
    hashes = files.withColumn("n", normalised_text(F.col("text"))).where("n <> ''").select("side", F.sha2("n", 256).alias("h")).distinct()
    a, b = (hashes.select(F.col("side").alias(x), "h") for x in "ab")
    both = a.join(b, "h").where("a < b")
    shared = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    first = first_n(both, ["a", "b"], ["h"], evidence).groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list(F.substring("h", 1, 12))), ",").alias("evidence"))
    sizes = hashes.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    n_a, n_b = (sizes.select(F.col("side").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    out = side_pairs(hashes, sides).join(shared, ["a", "b"], "left").join(first, ["a", "b"], "left").join(n_a, "a", "left").join(n_b, "b", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("a", "b", zero("n_a"), zero("n_b"), zero("shared"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.when(F.coalesce("shared", F.lit(0)) == 0, "PASS").otherwise("FAIL").alias("verdict"))


def residual(features: DataFrame, pairs: DataFrame, api: DataFrame | None = None) -> DataFrame:
    """(a, b, kind, feature): features of both sides that no other implementation has, nor (where given) an interface dictates.

    features: (impl, kind, feature), distinct; pairs: (a, b); api: (impl, feature). Each feature's holders are counted once: it is in no baseline if the pair are all of them.
    """
    holders = features.groupBy("kind", "feature").agg(F.count(F.lit(1)).alias("holders")).where("holders = 2")
    rare = features.join(holders, ["kind", "feature"], "left_semi")
    sides = rare.groupBy("kind", "feature").agg(F.min("impl").alias("lo"), F.max("impl").alias("hi"))
    ordered = pairs.select("a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    out = sides.join(ordered, ["lo", "hi"]).select("a", "b", "kind", "feature")
    if api is not None:
        of = lambda x: pairs.join(api, F.col("impl") == F.col(x)).select("a", "b", "feature")
        dictated = of("a").union(of("b")).distinct()
        out = out.join(dictated, ["a", "b", "feature"], "left_anti").select("a", "b", "kind", "feature")
    return out


def signature_verdict(a: Column, b: Column, shape: list[str]) -> Column:
    """strict for equal structs, renamed_args for equal shapes, else diverged."""
    same = F.lit(True)
    for f in shape:
        same = same & a[f].eqNullSafe(b[f])
    return F.when(a.eqNullSafe(b), "strict").when(same, "renamed_args").otherwise("diverged")


def class_verdicts(methods_a: DataFrame, methods_b: DataFrame, shape: list[str]) -> DataFrame:
    """One row a class of either side: counts of method verdicts, methods removed and added, and the worst of them.

    methods: (cls, method, d) with d the descriptor struct.
    """
    a, b = (m.select("cls", "method", F.col("d").alias(x)) for m, x in ((methods_a, "da"), (methods_b, "db")))
    both = a.join(b, ["cls", "method"], "full_outer")
    verdict = F.when(F.col("db").isNull(), "removed").when(F.col("da").isNull(), "added").otherwise(signature_verdict(F.col("da"), F.col("db"), shape))
    count = lambda v: F.count_if(F.col("v") == v).alias(v)
    in_a, in_b = F.max(F.col("da").isNotNull()), F.max(F.col("db").isNotNull())
    by = both.withColumn("v", verdict).groupBy("cls").agg(*(count(v) for v in ("strict", "renamed_args", "diverged", "removed", "added")), in_a.alias("in_a"), in_b.alias("in_b"))
    worst = F.when(~F.col("in_b"), "removed_class").when(~F.col("in_a"), "added_class").when(F.col("removed") + F.col("added") + F.col("diverged") > 0, "diverged").when(F.col("renamed_args") > 0, "renamed_args").otherwise("strict")
    return by.withColumn("verdict", worst).drop("in_a", "in_b")


def reconcile(expected: DataFrame, recomputed: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(name, expected, recomputed, agrees) of (name, value) relations: numbers within the tolerance, other texts equal; a missing side doesn't agree."""
    both = expected.select("name", F.col("value").cast("string").alias("expected")).join(recomputed.select("name", F.col("value").cast("string").alias("recomputed")), "name", "full_outer")
    a, b = (F.col(c).try_cast("double") for c in ("expected", "recomputed"))
    number = a.isNotNull() & b.isNotNull()
    return both.withColumn("agrees", F.coalesce(F.when(number, F.abs(a - b) <= tolerance).otherwise(F.col("expected") == F.col("recomputed")), F.lit(False)))


def displayed(measured: DataFrame, shown: DataFrame) -> DataFrame:
    """(name, measured, shown, agrees): a displayed decimal is right if its measurement, rounded half up to as many places, is that number."""
    both = measured.select("name", F.col("value").cast("decimal(28,12)").alias("measured")).join(shown.select("name", F.col("value").alias("shown")), "name")
    places = F.length(F.regexp_extract("shown", r"\.(\d+)$", 1))
    rounded = F.coalesce(*[F.when(places == p, F.round("measured", p).cast("decimal(28,12)")) for p in range(13)])
    return both.withColumn("agrees", rounded == F.col("shown").cast("decimal(28,12)"))


def dangling(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Links (src, rel, dst) whose end is no entity(id)."""
    return links.join(entities.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "rel", "dst")


def asymmetric(depends: DataFrame, blocks: DataFrame) -> DataFrame:
    """depends(id, on) without blocks(id, blocked) to match: where on does not block id."""
    return depends.join(blocks.select(F.col("id").alias("on"), F.col("blocked").alias("id")), ["id", "on"], "left_anti")


def evidence_coverage(claims: DataFrame, evidence: DataFrame, matrix: DataFrame) -> DataFrame:
    """(kind, id, links) of every claim and evidence: those without links are uncovered or unused."""
    out = None
    for kind, rows, key in (("claim", claims, "claim_id"), ("evidence", evidence, "evidence_id")):
        count = matrix.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("links"))
        part = rows.select("id").join(count, "id", "left").select(F.lit(kind).alias("kind"), "id", F.coalesce("links", F.lit(0)).alias("links"))
        out = part if out is None else out.unionByName(part)
    return out


def verdict_counts(rows: DataFrame, verdict: str = "verdict") -> DataFrame:
    """(verdict, n), most frequent first, then by name."""
    return rows.groupBy(F.col(verdict).alias("verdict")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "verdict")


def contract_outcome(exit_code: Column, stdout: Column, expected: Column, stderr: Column) -> Column:
    """SKIP where nothing ran, PASS for exit 0, equal bytes and no error output, else FAIL."""
    return F.when(exit_code.isNull(), "SKIP").when((exit_code == 0) & stdout.eqNullSafe(expected) & (F.length(stderr) == 0), "PASS").otherwise("FAIL")


def profile(source: Column, markers: dict[str, str], comment: str = "#") -> Column:
    """Whether a source, its comments left out, has every marker: a struct of booleans."""
    bare = F.regexp_replace(source, f"(?m){comment}.*$", "")
    return F.struct(*(bare.rlike(p).alias(n) for n, p in markers.items()))


def marker_survival(symbols: DataFrame, markers: dict[str, str]) -> DataFrame:
    """(node, distinct symbols that match each marker) of symbols(node, symbol)."""
    return symbols.groupBy("node").agg(*(F.count_distinct(F.when(F.col("symbol").rlike(p), F.col("symbol"))).alias(n) for n, p in markers.items()))
