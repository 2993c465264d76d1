"""Rank statistics, calibration and resampling over labels and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import statistics as T
from tracewell.operators.lineage import cut
from tracewell.plans.registry import query, table


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


@query(
    """WITH d AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)) SELECT lang, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg,
    round((SELECT sum(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0 END) / count(*) FROM d p JOIN d n ON p.lang = n.lang WHERE p.quality = 1 AND n.quality <> 1 AND p.lang = d.lang), 9) AS auc FROM d GROUP BY 1"""
)
def a12_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's length tells its quality, by language."""
    return T.auc(labelled(spark, sf_dir), ["lang"], "n_chars", F.col("quality") == 1).select("lang", "n_pos", "n_neg", F.round("auc", 9).alias("auc"))


@query(
    """WITH d AS (SELECT source, n_chars, length(text) - length(replace(text, ' ', '')) AS blanks FROM documents), r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2 AS a, rank() OVER (PARTITION BY source ORDER BY blanks) + (count(*) OVER (PARTITION BY source, blanks) - 1) / 2 AS b FROM d)
    SELECT source, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1"""
)
def a26_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "n_chars", (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))).alias("blanks"))
    return T.spearman(docs, ["source"], "n_chars", "blanks").select("source", "n", F.round("rho", 6).alias("rho"))


@query(
    """WITH d AS (SELECT lang, (n_chars % 101) / 100 AS p, quality AS y FROM documents JOIN labels USING (doc_id)), b AS (SELECT lang, least(floor(p * 10), 9) AS bin, count(*) AS m, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS sq FROM d GROUP BY 1, 2)
    SELECT lang, sum(m)::BIGINT AS n, round(sum(sq) / sum(m), 9) AS brier, round(sum(abs(sp - sy)) / sum(m), 9) AS ece FROM b GROUP BY 1"""
)
def a27_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("p", (F.col("n_chars") % 101) / 100)
    return T.brier_ece(rows, ["lang"], "p", F.col("quality") == 1).select("lang", "n", F.round("brier", 9).alias("brier"), F.round("ece", 9).alias("ece"))


@query(
    """WITH f AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS idx, avg(n_chars) AS v FROM documents GROUP BY lang, source), s AS (SELECT lang, count(*) AS n FROM f GROUP BY 1),
    dr AS (SELECT lang, rep, ('0x' || substr(md5(rep || '|' || draw || '|20260528'), 1, 8))::UBIGINT % n AS idx FROM (SELECT lang, n, unnest(range(n)) AS draw FROM s) CROSS JOIN (SELECT range AS rep FROM range(1000))),
    m AS (SELECT dr.lang, rep, avg(v) AS metric FROM dr JOIN f ON f.lang = dr.lang AND f.idx = dr.idx GROUP BY 1, 2) SELECT lang, round(quantile_cont(metric, 0.025), 6) AS lower, round(quantile_cont(metric, 0.975), 6) AS upper, count(*) AS n_resamples FROM m GROUP BY 1"""
)
def a22_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of the mean length over sources, resampled with replacement, by language."""
    from pyspark.sql import Window

    parts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("v"))
    parts = cut(parts.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    groups = parts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    drawn = T.draws(spark, 1000, F.col("n"), groups)
    metrics = drawn.join(parts, ["lang", "idx"]).groupBy("lang", "rep").agg(F.avg("v").alias("metric"))
    found = T.percentile_interval(metrics, ["lang"], "metric")
    return found.select("lang", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n_resamples")


@query("WITH d AS (SELECT DISTINCT source, n_chars FROM documents) SELECT source, n_chars, rank() OVER (PARTITION BY source ORDER BY n_chars) AS place FROM d")
def w6_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").select("source", "n_chars").distinct()
    return rows.withColumn("place", F.rank().over(Window.partitionBy("source").orderBy("n_chars")))


@query()
def q24_power_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power over families and effects, with the operator's own numbers of simulations and resamples; simulated, so tests hold it within its Monte Carlo error."""
    cells = [(i, k, 5, 5, auc, 0.35, 0.7) for i, (k, auc) in enumerate((k, auc) for k in (3, 5, 8) for auc in (0.8, 0.9))]
    frame = spark.createDataFrame(cells, "cell int, families int, n_pos int, n_neg int, mean_auc double, tau double, theta double").repartition("cell")
    return T.power_map(frame)
