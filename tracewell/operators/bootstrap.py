"""Percentile intervals of pair metrics over resampled files.

A resample is a relation (rep, side, path, weight), so that one plan works out the metric of every replicate: contributions of files are joined to it once. Graph metrics use
sets (a file drawn twice adds nothing), histogram metrics use multisets (its counts double).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.columns import rel_diff, safe_div
from tracewell.operators import graph as G
from tracewell.operators.statistics import numpy_draws, percentile_interval

#: Measures of a graph that a topology similarity compares.
TOPOLOGY = ["nodes", "edges", "density", "sccs", "mean_in", "mean_out", "max_in", "max_out"]


def resamples(spark: SparkSession, a: list[str], b: list[str], reps: int = 1000, seed: int = 20260528) -> DataFrame:
    """Files of both sides drawn with replacement, from one numpy generator (side a, then side b, in each replicate); reps x files rows."""
    rows = []
    for rep, drawn in enumerate(numpy_draws(reps, len(a), len(b), seed)):
        for side, paths, idx in zip("ab", (a, b), drawn):
            rows += [(rep, side, paths[i], n) for i, n in Counter(idx.tolist()).items()]
    return spark.createDataFrame(rows, "rep int, side string, path string, weight int")


def _cosine(hist: DataFrame, drawn: DataFrame) -> DataFrame:
    """(rep, metric) of hist(rep, ..., a, b); zero for a replicate whose files hold nothing."""
    sums = hist.groupBy("rep").agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("b") ** 2).alias("bb"))
    metric = safe_div(F.col("dot"), F.sqrt("aa") * F.sqrt("bb"))
    return drawn.select("rep").distinct().join(sums, "rep", "left").select("rep", F.coalesce(metric, F.lit(0.0)).alias("metric"))


def histogram_cosine(contributions: DataFrame, drawn: DataFrame) -> DataFrame:
    """(rep, metric) of contributions(side, path, key, cnt)."""
    hist = contributions.join(drawn, ["side", "path"]).groupBy("rep", "key").agg(*(F.sum(F.when(F.col("side") == s, F.col("cnt") * F.col("weight")).otherwise(0)).cast("double").alias(s) for s in "ab"))
    return _cosine(hist, drawn)


def _graphs(functions: DataFrame, calls: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs named by struct(rep, side), from functions(side, path, id) and calls(side, path, src, dst)."""
    g = F.struct("rep", "side").alias("g")
    return G.merge(functions.join(drawn, ["side", "path"]).select(g, "id"), calls.join(drawn, ["side", "path"]).select(g, "src", "dst"))


def topology_similarity(functions: DataFrame, calls: DataFrame, drawn: DataFrame) -> DataFrame:
    """(rep, metric): one less the mean relative difference of the graphs' measures."""
    t = G.topology(*_graphs(functions, calls, drawn))
    sides = [t.where(F.col("g.side") == s).select(F.col("g.rep").alias("rep"), *(F.col(c).alias(f"{c}_{s}") for c in TOPOLOGY)) for s in "ab"]
    mean = sum((rel_diff(F.col(f"{c}_a").cast("double"), F.col(f"{c}_b").cast("double")) for c in TOPOLOGY), F.lit(0.0)) / len(TOPOLOGY)
    reps = drawn.select("rep").distinct()  # a graph without nodes has zeros
    return reps.join(sides[0], "rep", "left").join(sides[1], "rep", "left").na.fill(0).select("rep", (1 - mean).alias("metric"))


def wl_cosine(functions: DataFrame, calls: DataFrame, drawn: DataFrame, rounds: int = 4) -> DataFrame:
    """(rep, metric): cosine of the graphs' label multisets."""
    labels = G.wl_labels(*_graphs(functions, calls, drawn), rounds=rounds)
    hist = labels.groupBy(F.col("g.rep").alias("rep"), "iter", "label").agg(*(F.count_if(F.col("g.side") == s).cast("double").alias(s) for s in "ab"))
    return _cosine(hist, drawn)


def mean_similarity(matches: DataFrame, reps: int = 1000, seed: int = 20260528) -> DataFrame:
    """(rep, metric): one less the mean distance of matches drawn with replacement; matches(idx, distance) are numbered from 0."""
    spark, n = matches.sparkSession, matches.count()
    rows = [(rep, i, k) for rep, (idx, _) in enumerate(numpy_draws(reps, n, 0, seed)) for i, k in Counter(idx.tolist()).items()]
    drawn = spark.createDataFrame(rows, "rep int, idx int, weight int")
    return drawn.join(matches, "idx").groupBy("rep").agg((1 - F.sum(F.col("distance") * F.col("weight")) / F.sum("weight")).alias("metric"))


def interval(metrics: DataFrame, signal: str) -> DataFrame:
    """(signal, lower, upper, n_resamples)."""
    return percentile_interval(metrics.withColumn("signal", F.lit(signal)), ["signal"], "metric")
