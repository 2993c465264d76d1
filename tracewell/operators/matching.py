"""Gated nearest matches and one-to-one matches of descriptors.

A descriptor has arity, tot (its size), cyc, depth, ret, loop and a histogram h (map<string,int>, or counts in an array of one length). Gates come before cosines. The gate on the
ratio of sizes becomes an equality: sizes are bucketed by their logarithm, and the other side is offered to the buckets that can hold a partner, so that both sides meet in a cogroup and
never in a nested loop. A cogroup is cut into blocks, so that no task gets more rows than two blocks have; inside, `nearest` searches with matrix products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.functions.columns import band
from tracewell.operators import nearest as N

DESCRIPTOR = ["arity", "tot", "cyc", "depth", "ret", "loop", "h"]


def coverage(rows: DataFrame, group: list[str], order: list[Column | str], share: float) -> DataFrame:
    """The first max(1, round(n * share)) rows of each group; halves round to even."""
    w = Window.partitionBy(*group)
    n = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * F.lit(share)).cast("int"))
    return rows.withColumn("_n", n).withColumn("_i", F.row_number().over(w.orderBy(*order))).where(F.col("_i") <= F.col("_n")).drop("_n", "_i")


#: Sizes of one bucket differ by this factor at most.
_WIDTH = 4.0
#: About so many rows of each side make a block.
BLOCK = 50000


def _offered(a: DataFrame, b: DataFrame, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with a bucket of their sizes' logarithm, b in each that can hold an a of which it has low to high times the size. Sizes of zero meet nothing."""
    bucket = lambda tot: F.floor(F.log(tot) / F.log(F.lit(_WIDTH))).cast("int")
    tot = F.col("tot").cast("double")
    return a.where("tot > 0").withColumn("at", bucket(tot)), b.where("tot > 0").withColumn("at", F.explode(F.sequence(bucket(tot / (high * 1.01)), bucket(tot / (low * 0.99)))))


def _in_blocks(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that both sides have, in blocks (i, j): every block of a meets every block of b with its keys."""
    blocks = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(n))
    n = blocks(a, "n_i").join(blocks(b, "n_j"), keys)
    draw = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return a.join(n, keys).withColumn("i", draw("n_i")).withColumn("j", every("n_j")).drop("n_i", "n_j"), b.join(n, keys).withColumn("j", draw("n_j")).withColumn("i", every("n_i")).drop("n_i", "n_j")


def _gated_best(a: DataFrame, b: DataFrame, equal: list[str], near: list[str], low: float, high: float) -> DataFrame:
    """For each descriptor of a its best candidate of those that are equal and within one in the columns named, and from low to high times the size; null and 0 where there is none."""
    keys, gates = ["pair", *equal, "at"], [*near, "tot", "order", "h"]
    left, right = _in_blocks(*_offered(*(df.select("pair", *equal, "id", *gates).na.drop(subset=[*equal, *near, "tot", "h"]) for df in (a, b)), low, high), keys)
    pair, kind, order = (a.schema[c].dataType for c in ("pair", "id", "order"))
    out = T.StructType([T.StructField("pair", pair), T.StructField("id_a", kind), T.StructField("m", T.StructType([T.StructField("id_b", kind), T.StructField("cosine", T.DoubleType()), T.StructField("order_b", order)]))])

    def search(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.rename_columns([c.removeprefix("b_") for c in y.column_names])
        h_x, h_y = N.histograms(x["h"], y["h"])
        stack = lambda t: np.stack([N.numbers(t, c) for c in near], axis=1)
        at, best = N.nearest(stack(x), N.numbers(x, "tot"), h_x, stack(y), N.numbers(y, "tot"), N.numbers(y, "order"), h_y, low, high)
        rows = np.flatnonzero(at >= 0)
        hit = y.select(["id", "order"]).take(pa.array(at[rows])).combine_chunks()
        one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
        found = pa.StructArray.from_arrays([one(hit["id"]), pa.array(best[rows]), one(hit["order"])], ["id_b", "cosine", "order_b"])
        return pa.table({"pair": x["pair"].take(pa.array(rows)), "id_a": x["id"].take(pa.array(rows)), "m": found})

    by = [*keys, "i", "j"]
    right = right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns))  # both sides may come from one plan: each gets columns of its own
    found = left.groupBy(*by).cogroup(right.groupBy(*(f"b_{c}" for c in by))).applyInArrow(search, out)
    best = found.groupBy("pair", "id_a").agg(F.max_by("m", F.struct(F.col("m.cosine"), F.expr("-m.order_b"))).alias("m"))
    return a.select("pair", F.col("id").alias("id_a"), "cyc").join(best, ["pair", "id_a"], "left").select("pair", "id_a", "cyc", F.col("m.id_b").alias("id_b"), F.coalesce("m.cosine", F.lit(0.0)).alias("cosine"))


def naive_best(a: DataFrame, b: DataFrame) -> DataFrame:
    """Best match by arity within one and half to twice the size. a, b: (pair, id, order, descriptor)."""
    return _gated_best(a, b, [], ["arity"], 0.5, 2.0)


def strict_best(a: DataFrame, b: DataFrame) -> DataFrame:
    """Best match by equal loops; arity, depth and returns within one; 0.67 to 1.5 times the size."""
    return _gated_best(a, b, ["loop"], ["arity", "depth", "ret"], 0.67, 1.5)


def verdict(matches: DataFrame, twin: float = 0.95) -> DataFrame:
    """TWIN, weak or NONE for each match, and its band."""
    v = F.when(F.col("id_b").isNull(), "NONE").when(F.col("cosine") >= twin, "TWIN").otherwise("weak")
    return matches.withColumn("verdict", v).withColumn("band", band(F.col("cyc")))


def band_counts(verdicts: DataFrame) -> DataFrame:
    """(pair, band, twin, weak, none, n, twin_share)."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    n = F.count(F.lit(1))
    return verdicts.groupBy("pair", "band").agg(count("TWIN").alias("twin"), count("weak").alias("weak"), count("NONE").alias("none"), n.alias("n"), (count("TWIN") / n).alias("twin_share"))


def sweep(matches: DataFrame, floors: list[int], cutoffs: list[float]) -> DataFrame:
    """(pair, floor, cutoff, n, twins) over a grid of complexity floors and cosine cutoffs."""
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("floor"), F.lit(c).alias("cutoff")) for f in floors for c in cutoffs]))
    rows = matches.select("pair", "cyc", "cosine", "id_b", grid.alias("g")).select("pair", "cyc", "cosine", "id_b", "g.*").where("cyc >= floor")
    return rows.groupBy("pair", "floor", "cutoff").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("cosine") >= F.col("cutoff")) & F.col("id_b").isNotNull()).alias("twins"))


def null_panel(verdicts: DataFrame) -> DataFrame:
    """(source, mean, largest) share of twins of a source over a panel of unrelated targets; pair is struct(source, target)."""
    share = verdicts.groupBy("pair").agg((F.count_if(F.col("verdict") == "TWIN") / F.count(F.lit(1))).alias("share"))
    return share.groupBy(F.col("pair.source").alias("source")).agg(F.avg("share").alias("mean"), F.max("share").alias("largest"))


def _one_by_one(candidates: DataFrame) -> DataFrame:
    """The sequential rule: a pair's candidates in order, each taken if its i and j are free."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        seen_i, seen_j, keep = set(), set(), []
        df = df.sort_values(["distance", "i", "j"])
        for i, j in zip(df["i"], df["j"]):
            free = i not in seen_i and j not in seen_j
            keep.append(free)
            if free:
                seen_i.add(i)
                seen_j.add(j)
        return df[keep]

    return candidates.groupBy("pair").applyInPandas(run, candidates.schema)


def mutual_greedy(candidates: DataFrame, tail_rows: int = 0) -> DataFrame:
    """Greedy one-to-one matches: (pair, i, j, distance), taken in ascending (distance, i, j), each i and j of a pair once; rows with a null in these take no part.

    Candidates are in total order, so every one that is the first of both its i and its j would be taken by the sequential rule too. A round takes all of those at
    once and drops what they touch, until tail_rows or fewer are left, which the sequential rule finishes: the result is the same for every tail_rows, and no task gets more rows than that. With 0 there are rounds alone, and no Python.
    """
    from tracewell.operators.lineage import cut

    order = F.struct("distance", "i", "j")
    left, out = cut(candidates.select("pair", "i", "j", "distance").na.drop()), None
    while (n := left.count()) > tail_rows:  # a round takes the first candidate of each pair at least
        first_i = left.groupBy("pair", "i").agg(F.min(order).alias("fi"))
        first_j = left.groupBy("pair", "j").agg(F.min(order).alias("fj"))
        taken = left.join(first_i, ["pair", "i"]).join(first_j, ["pair", "j"]).where((F.col("fi") == order) & (F.col("fj") == order)).select("pair", "i", "j", "distance")
        taken = cut(taken)
        out = taken if out is None else out.unionByName(taken)
        left = cut(left.join(taken.select("pair", "i"), ["pair", "i"], "left_anti").join(taken.select("pair", "j"), ["pair", "j"], "left_anti"))
    rest = _one_by_one(left) if n else left
    return rest if out is None else out.unionByName(rest)


def nearest_greedy(a: DataFrame, b: DataFrame) -> DataFrame:
    """Greedy one-to-one matches inside equal signatures: (pair, i, j, distance), taken in ascending (distance, i, j), each i and j of a pair once; distances to nine digits.

    a, b: (pair, sig, id, h, depth, ret), an id once in a pair; rows with a null in these take no part. The result is that of `mutual_greedy` over all candidates, which are never written out: as
    no candidate joins two signatures, each signature of a pair is a task's own, and `nearest.greedy` looks at the candidates that can be next.
    """
    columns = ["pair", "sig", "id", "h", "depth", "ret"]
    one = lambda df: df.na.drop(subset=columns).select("pair", F.to_json(F.struct("sig")).alias("sig"), "id", "h", "depth", "ret")
    a, b = one(a), one(b)
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    kind = a.schema["id"].dataType
    out = T.StructType([T.StructField("pair", a.schema["pair"].dataType), T.StructField("i", kind), T.StructField("j", kind), T.StructField("distance", T.DoubleType())])
    none = to_arrow_schema(out).empty_table()

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        left, right = left.sort_by("id"), right.sort_by("b_id")
        h_a, h_b = N.histograms(left["h"], right["b_h"])
        x_a, x_b = (np.stack([N.numbers(t, f"{x}{c}") for c in ("depth", "ret")], axis=1) for t, x in ((left, ""), (right, "b_")))
        at, to, distance = N.greedy(h_a, x_a, h_b, x_b)
        at, to = pa.array(at), pa.array(to)
        return pa.table({"pair": left["pair"].take(at), "i": left["id"].take(at), "j": right["b_id"].take(to), "distance": distance})

    return a.groupBy("pair", "sig").cogroup(b.groupBy("b_pair", "b_sig")).applyInArrow(match, out)


def in_order_greedy(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy nearest matches in the left side's order, inside equal signatures: each left row takes the most similar right row that is free, if that reaches `least`.

    a, b: (pair, sig, order, id, h). The rule is sequential by definition, so each signature of a pair is one task's; a signature holds the functions of two packages that share a shape.
    """

    # both sides may come from one plan: each gets columns of its own, or the cogroup would mix them up
    sig = F.to_json(F.struct("sig")).alias("sig")
    a, b = a.select("pair", sig, "order", "id", "h"), b.select(*(F.col(c).alias(f"b_{c}") for c in ("pair", "order", "id", "h")), sig.alias("b_sig"))
    out = T.StructType([T.StructField(c, t) for c, t in (("pair", a.schema["pair"].dataType), ("id_a", a.schema["id"].dataType), ("id_b", a.schema["id"].dataType), ("cosine", T.DoubleType()))])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out_arrow.empty_table()
        left, right = left.sort_by("order"), right.sort_by("b_order")
        at, to, cosine = N.in_order(*N.histograms(left["h"], right["b_h"]), least)
        at, to = pa.array(at), pa.array(to)
        return pa.table({"pair": left["pair"].take(at), "id_a": left["id"].take(at), "id_b": right["b_id"].take(to), "cosine": cosine})

    out_arrow = to_arrow_schema(out)
    return a.groupBy("pair", "sig").cogroup(b.groupBy("b_pair", "b_sig")).applyInArrow(match, out)


def match_rollup(matched: DataFrame, n_a: int, n_b: int) -> dict:
    """Mean similarity over matches, matches, and the unmatched of both sides."""
    row = matched.agg(F.avg("distance").alias("d"), F.count(F.lit(1)).alias("n")).first()
    return {"similarity": 1 - row.d if row.n else 0.0, "matched": row.n, "unmatched_a": n_a - row.n, "unmatched_b": n_b - row.n}
