"""Set, multiset and histogram similarities of sides.

Every relation is long: (side, key, cnt). A pair is a join of the relation with itself on the key, so all pairs of all sides cost one shuffle; what a key contributes to a pair is
added up before the next one. Sums of squares and totals are one row a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import rel_diff, safe_div


def histogram(rows: DataFrame, side: str, key: str) -> DataFrame:
    """(side, key, cnt) of rows(side, key)."""
    return rows.groupBy(F.col(side).alias("side"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("cnt"))


def shares(hist: DataFrame) -> DataFrame:
    """hist with each key's share of its side's total."""
    totals = hist.groupBy("side").agg(F.sum("cnt").alias("total"))
    return hist.join(totals, "side").withColumn("share", safe_div(F.col("cnt"), F.col("total"))).drop("total")


def side_pairs(hist: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(a, b) with a < b: all pairs of sides; the sides are those given, or those of the relation."""
    s = (sides or hist.select("side")).distinct()
    return s.select(F.col("side").alias("a")).join(s.select(F.col("side").alias("b")), F.col("a") < F.col("b"))


def _common(hist: DataFrame) -> DataFrame:
    """(a, b, key, ca, cb) of the keys that both sides have."""
    left, right = (hist.select(F.col("side").alias(x), "key", F.col("cnt").alias(f"c{x}")) for x in "ab")
    return left.join(right, "key").where("a < b")


def _with_sides(common: DataFrame, hist: DataFrame, sides: DataFrame | None, per_side: Column) -> DataFrame:
    """Every pair, with its sums over common keys and each side's own measure ma, mb (null without keys)."""
    own = hist.groupBy("side").agg(per_side.alias("m"))
    a, b = (own.select(F.col("side").alias(x), F.col("m").alias(f"m{x}")) for x in "ab")
    return side_pairs(hist, sides).join(common, ["a", "b"], "left").join(a, "a", "left").join(b, "b", "left")


def cosine(hist: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine); 0 if a side is empty."""
    dot = _common(hist).groupBy("a", "b").agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("dot"))
    norm = F.sqrt(F.sum(F.col("cnt").cast("double") * F.col("cnt")))
    return _with_sides(dot, hist, sides, norm).select("a", "b", safe_div(F.col("dot"), F.col("ma") * F.col("mb")).alias("cosine"))


def jaccard(hist: DataFrame, sides: DataFrame | None = None, both_empty: float = 0.0) -> DataFrame:
    """(a, b, shared, jaccard) of the key sets; `both_empty` for two empty sets."""
    shared = _common(hist).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = _with_sides(shared, hist, sides, F.count(F.lit(1))).select("a", "b", *(zero(c).alias(c) for c in ("shared", "ma", "mb")))
    return both.select("a", "b", "shared", F.when(F.col("ma") + F.col("mb") == 0, both_empty).otherwise(safe_div(F.col("shared"), F.col("ma") + F.col("mb") - F.col("shared"))).alias("jaccard"))


def overlap(hist: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(a, b, overlap): the multiset intersection's share of the smaller side; 0 if a side is empty.

    The sides of a key come together once, and pairs are added up where they are. A side with itself gives its total, so that nothing else reads the relation; `own` is an aggregate so that
    no filter on it goes below, and all uses of the sums share one shuffle.
    """
    holders = hist.groupBy("key").agg(F.collect_list(F.struct("side", "cnt")).alias("s"))
    both = holders.select("s", F.explode("s").alias("x")).select("x", F.explode("s").alias("y")).where("x.side <= y.side")
    sums = both.select(F.col("x.side").alias("a"), F.col("y.side").alias("b"), F.least("x.cnt", "y.cnt").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("least"), F.bool_and(F.col("a") == F.col("b")).alias("own"))
    own = sums.where("own")
    a, b = (own.select(F.col("a").alias(x), F.col("least").alias(f"m{x}")) for x in "ab")
    pairs = a.join(b, F.col("a") < F.col("b")) if sides is None else side_pairs(hist, sides).join(a, "a", "left").join(b, "b", "left")
    return pairs.join(sums.where("not own").select("a", "b", "least"), ["a", "b"], "left").select("a", "b", safe_div(F.col("least"), F.least("ma", "mb")).alias("overlap"))


def top_terms(hist: DataFrame, a: str, b: str, n: int = 6) -> DataFrame:
    """The n keys with the largest total count in two sides; the smaller key first among equals."""
    counts = [F.coalesce(F.sum(F.when(F.col("side") == x, F.col("cnt"))), F.lit(0)).alias(y) for x, y in ((a, "cnt_a"), (b, "cnt_b"))]
    return hist.where(F.col("side").isin(a, b)).groupBy("key").agg(*counts).orderBy(F.desc(F.col("cnt_a") + F.col("cnt_b")), "key").limit(n)


def feature_similarity(features: DataFrame, side: str, names: list[str], sides: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): one less the mean symmetric relative difference of the named features; features has one row a side."""
    a, b = (features.select(F.col(side).alias(x), *(F.col(n).alias(f"{n}_{x}") for n in names)) for x in "ab")
    mean = sum((rel_diff(F.col(f"{n}_a"), F.col(f"{n}_b")) for n in names), F.lit(0.0)) / len(names)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (1 - mean).alias("similarity"))


def envelope(*measures: Column) -> tuple[Column, Column, Column, Column]:
    """Smallest, second smallest, upper median and largest of measures that aren't NaN or null."""
    values = F.array_sort(F.filter(F.array(*measures), lambda v: v.isNotNull() & ~F.isnan(v)))
    at = lambda i: F.try_element_at(values, i)
    return at(F.lit(1)), at(F.lit(2)), at(F.floor(F.size(values) / 2).cast("int") + 1), at(F.size(values))


def nan_mean(*measures: Column) -> Column:
    """Mean of the measures that are neither NaN nor null; NaN if there is none."""
    values = F.filter(F.array(*measures), lambda v: v.isNotNull() & ~F.isnan(v))
    return safe_div(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values), float("nan"))


def first_n(rows: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key in an order; the window's limit is pushed below the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
