"""Connected components of a graph that no task and no driver holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the component's smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges are stars around the smallest nodes; the number of steps
    grows with the logarithm of the largest component. A node's minimum is written to the shared folder before it is joined back: the join then needn't take over the
    partitions of an aggregate, so that Spark may split a hub with many edges over tasks. Each step is written there too, and the one before it is dropped.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at = scratch.write(both, "edges")
    last = None
    while True:
        # large star: each larger neighbour of u goes to the smallest of u and its neighbours
        sides = at.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(at.select(F.col("v").alias("n"), F.col("u").alias("o")))
        low = scratch.write(sides.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m")), "low")
        large = sides.where("o > n").join(low, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, "large")
        scratch.drop(low, at)
        # small star: each smaller neighbour of u, and u, go to the smallest of them
        low = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.where("u <> v").distinct(), "small")
        scratch.drop(large, low)
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == last:
            break
        at, last = new, tuple(seen)
    roots = new.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
