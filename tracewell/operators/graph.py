"""Directed graphs as relations: nodes(g, id) and edges(g, src, dst), many graphs at once, set semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import safe_div
from tracewell.operators.lineage import cut


def merge(functions: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and edges from contributions of files: functions(g, id) and calls(g, src, dst)."""
    edges = calls.select("g", "src", "dst").distinct()
    ends = edges.select("g", F.explode(F.array("src", "dst")).alias("id"))
    return functions.select("g", "id").unionByName(ends).distinct(), edges


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, id, n_in, n_out) of every node; one shuffle for both directions."""
    ends = edges.select("g", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    every = ends.select("g", "e.id", "e.i", "e.o").unionByName(nodes.select("g", "id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return every.groupBy("g", "id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a graph: nodes, edges, density, strong components, mean and largest degrees."""
    d = degrees(nodes, edges).groupBy("g")
    strong = strong_components(nodes, edges).groupBy("g").agg(F.count_distinct("component").alias("sccs"))
    n, m = F.col("nodes"), F.col("edges")
    out = d.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n_out").alias("edges"), F.avg("n_in").alias("mean_in"), F.avg("n_out").alias("mean_out"), F.max("n_in").alias("max_in"), F.max("n_out").alias("max_out"))
    return out.withColumn("density", safe_div(m, n * (n - 1))).join(strong, "g")


def wl_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 4, successors_only: bool = False) -> DataFrame:
    """(g, iter, id, label): Weisfeiler-Lehman labels of rounds 0..rounds.

    A label starts as the in- and out-degree. A round hashes a node's label with the sorted labels of its in- and out-neighbours (out-neighbours alone if
    `successors_only`). Each round reads the one before from the shared folder, so lineage doesn't grow.
    """
    label = F.concat_ws("_", "n_in", "n_out") if successors_only else F.format_string("d:%d|%d", "n_in", "n_out")
    at = cut(degrees(nodes, edges).select("g", "id", label.alias("label")))
    out = at.select("g", F.lit(0).alias("iter"), "id", "label")
    for i in range(1, rounds + 1):
        to = edges.join(at.select("g", F.col("id").alias("dst"), "label"), ["g", "dst"]).select("g", F.col("src").alias("id"), F.lit("out").alias("side"), "label")
        if not successors_only:
            to = to.unionByName(edges.join(at.select("g", F.col("id").alias("src"), "label"), ["g", "src"]).select("g", F.col("dst").alias("id"), F.lit("in").alias("side"), "label"))
        lists = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("label")))), ",").alias(s) for s in (("out",) if successors_only else ("in", "out"))]
        around = to.groupBy("g", "id").agg(*lists)
        parts = [F.coalesce(s, F.lit("")) for s in (("out",) if successors_only else ("in", "out"))]
        at = cut(at.join(around, ["g", "id"], "left").select("g", "id", F.substring(F.sha2(F.concat_ws("||", "label", *parts), 256), 1, 16).alias("label")))
        out = out.unionByName(at.select("g", F.lit(i).alias("iter"), "id", "label"))
    return out


def reachable(edges: DataFrame) -> DataFrame:
    """(g, src, dst) of all pairs with a path, by doubling path lengths."""
    at = cut(edges.select("g", "src", "dst").distinct())
    count = at.count()
    while True:
        longer = at.join(at.select("g", F.col("src").alias("dst"), F.col("dst").alias("to")), ["g", "dst"]).select("g", "src", F.col("to").alias("dst"))
        at = cut(at.unionByName(longer).distinct())
        new = at.count()
        if new == count:
            return at
        count = new


def _settle(at: DataFrame, step, steps: int = 3) -> DataFrame:
    """Repeats a step on (g, id, ...) until its rows stay the same, a few steps to a written table."""
    total = None
    while True:
        for _ in range(steps):
            at = step(at)
        at = cut(at)
        new = tuple(at.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*at.columns).cast("decimal(20,0)"))).first())
        if new == total:
            return at
        total = new


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, id, component): component is the smallest node that a node reaches and is reached by.

    Colouring (Orzan, 2004): a round settles nodes without edges in or out as they are; spreads to each other node the smallest node that reaches it, its colour; and finds backwards from
    each colour's own node what reaches it inside the colour: its component. The rest go on without them. Every step is a join and an aggregate; no closure is built.
    """
    done, left = None, nodes.select("g", "id")
    while True:
        inside = edges.join(left.select("g", F.col("id").alias("src")), ["g", "src"], "left_semi").join(left.select("g", F.col("id").alias("dst")), ["g", "dst"], "left_semi")
        inside = cut(inside.select("g", "src", "dst"))
        both = inside.select("g", F.col("src").alias("id")).intersect(inside.select("g", F.col("dst").alias("id")))
        alone = left.join(both, ["g", "id"], "left_anti").select("g", "id", F.col("id").alias("component"))

        def ahead(at: DataFrame, inside: DataFrame = inside) -> DataFrame:
            sent = inside.join(at.select("g", F.col("id").alias("src"), "low"), ["g", "src"]).select("g", F.col("dst").alias("id"), "low")
            return at.unionByName(sent).groupBy("g", "id").agg(F.min("low").alias("low"))

        colours = _settle(both.select("g", "id", F.col("id").alias("low")), ahead)
        at, to = (colours.select("g", F.col("id").alias(x), F.col("low").alias(f"low_{x}")) for x in ("src", "dst"))
        same = cut(inside.join(at, ["g", "src"]).join(to, ["g", "dst"]).where("low_src = low_dst").select("g", "src", "dst"))

        def behind(at: DataFrame, same: DataFrame = same) -> DataFrame:
            sent = same.join(at.select("g", F.col("id").alias("dst"), "component"), ["g", "dst"]).select("g", F.col("src").alias("id"), "component")
            return at.unionByName(sent).distinct()

        settled = _settle(colours.where(F.col("id") == F.col("low")).select("g", "id", F.col("low").alias("component")), behind)
        settled = cut(settled.unionByName(alone))
        done = settled if done is None else done.unionByName(settled)
        left = cut(left.join(settled, ["g", "id"], "left_anti"))
        if left.isEmpty():
            return done


def longest_paths(units: DataFrame, depends: DataFrame) -> DataFrame:
    """(g, id, layer, weight, path): the heaviest path that ends at each unit of a DAG; units(g, id, loc), depends(g, id, on).

    Layers are settled one at a time, a round a layer, until none is left; ties go to the smaller path. Units in a cycle, or behind one, raise an error.
    """
    count = units.count()
    first = units.join(depends.select("g", "id").distinct(), ["g", "id"], "left_anti")
    at = cut(first.select("g", "id", F.lit(0).alias("layer"), F.col("loc").cast("long").alias("weight"), F.array("id").alias("path")))
    best, layer = at, 0
    while not at.isEmpty():
        layer += 1
        if layer > count:
            raise ValueError("units depend on each other in a cycle")
        step = at.select("g", F.col("id").alias("on"), "weight", "path").join(depends, ["g", "on"]).join(units, ["g", "id"])
        step = step.select("g", "id", F.lit(layer).alias("layer"), (F.col("weight") + F.col("loc")).alias("weight"), F.concat("path", F.array("id")).alias("path"))
        at = cut(step.groupBy("g", "id").agg(F.max("layer").alias("layer"), F.max_by(F.struct("weight", "path"), F.col("weight")).alias("b")).select("g", "id", "layer", "b.weight", "b.path"))
        best = best.unionByName(at)
    out = cut(best.groupBy("g", "id").agg(F.max("layer").alias("layer"), F.max("weight").alias("weight"), F.max_by("path", "weight").alias("path")))
    if out.count() < count:
        raise ValueError("units depend on each other in a cycle")
    return out
