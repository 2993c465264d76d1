"""Histograms, sets and multisets of the documents' words, by language and by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.columns import QUIRK_STOP, is_distinctive, is_message, message, shingles, words
from tracewell.operators import similarity as S
from tracewell.plans.registry import query, table

_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(QUIRK_STOP)))
_WORDS_SQL = "SELECT lang, source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents"
_HIST_SQL = f"hist AS (SELECT lang AS side, word AS key, count(*) AS cnt FROM ({_WORDS_SQL}) GROUP BY 1, 2)"
_SOURCE_SETS_SQL = f"feats AS (SELECT DISTINCT source AS side, word AS key FROM ({_WORDS_SQL}) WHERE word NOT IN ({_STOP_SQL}))"
_PAIRS_SQL = "pairs AS (SELECT x.side AS a, y.side AS b FROM (SELECT DISTINCT side FROM {0}) x JOIN (SELECT DISTINCT side FROM {0}) y ON x.side < y.side)"


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.explode(words(F.col("text"))).alias("word"))


def word_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(doc_words(spark, sf_dir), "lang", "word")


def source_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of each source but stop words, as (side, key, cnt)."""
    rows = doc_words(spark, sf_dir).where(~F.col("word").isin(QUIRK_STOP))
    return rows.select(F.col("source").alias("side"), F.col("word").alias("key")).distinct().withColumn("cnt", F.lit(1))


@query(f"WITH {_HIST_SQL} SELECT side, key, cnt, round(cnt / sum(cnt) OVER (PARTITION BY side), 9) AS share FROM hist")
def a1_a2_histogram_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shares(word_histogram(spark, sf_dir)).select("side", "key", "cnt", F.round("share", 9).alias("share"))


@query(
    f"""WITH {_HIST_SQL}, {_PAIRS_SQL.format("hist")}, norms AS (SELECT side, sqrt(sum(cnt::DOUBLE * cnt)) AS n FROM hist GROUP BY 1)
    SELECT p.a, p.b, round(coalesce(sum(x.cnt::DOUBLE * y.cnt), 0) / any_value(na.n) / any_value(nb.n), 9) AS cosine
    FROM pairs p JOIN norms na ON na.side = p.a JOIN norms nb ON nb.side = p.b LEFT JOIN hist x ON x.side = p.a LEFT JOIN hist y ON y.side = p.b AND y.key = x.key GROUP BY 1, 2"""
)
def a3_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cosine(word_histogram(spark, sf_dir)).select("a", "b", F.round("cosine", 9).alias("cosine"))


@query(
    f"""WITH {_SOURCE_SETS_SQL}, sides AS (SELECT DISTINCT side FROM feats UNION ALL SELECT 'zz-empty-1' UNION ALL SELECT 'zz-empty-2'), sizes AS (SELECT s.side, count(f.key) AS n FROM sides s LEFT JOIN feats f USING (side) GROUP BY 1),
    shared AS (SELECT x.side AS a, y.side AS b, count(*) AS shared FROM feats x JOIN feats y ON x.key = y.key AND x.side < y.side GROUP BY 1, 2)
    SELECT x.side AS a, y.side AS b, coalesce(shared, 0) AS shared, CASE WHEN x.n + y.n = 0 THEN 1.0 ELSE round(coalesce(shared, 0)::DOUBLE / (x.n + y.n - coalesce(shared, 0)), 9) END AS pilot_jaccard,
    CASE WHEN x.n + y.n = 0 THEN 0.0 ELSE round(coalesce(shared, 0)::DOUBLE / (x.n + y.n - coalesce(shared, 0)), 9) END AS harness_jaccard
    FROM sizes x JOIN sizes y ON x.side < y.side LEFT JOIN shared s ON s.a = x.side AND s.b = y.side"""
)
def a4_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules for two empty sets, with two empty sides beside the sources."""
    feats = source_words(spark, sf_dir)
    sides = feats.select("side").distinct().unionByName(spark.createDataFrame([("zz-empty-1",), ("zz-empty-2",)], "side string"))
    found = S.jaccard(feats, sides, both_empty=-1.0)
    rule = lambda x: F.when(F.col("jaccard") < 0, x).otherwise(F.round("jaccard", 9))
    return found.select("a", "b", "shared", rule(1.0).alias("pilot_jaccard"), rule(0.0).alias("harness_jaccard"))


@query(
    """WITH toks AS (SELECT source, doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents),
    grams AS (SELECT source AS side, array_to_string(list_slice(w, i, i + 4), ' ') AS key FROM (SELECT source, w, unnest(range(1, len(w) - 3)) AS i FROM toks WHERE len(w) >= 5)),
    hist AS (SELECT side, key, count(*) AS cnt FROM grams GROUP BY 1, 2), totals AS (SELECT side, sum(cnt) AS t FROM hist GROUP BY 1)
    SELECT p.side AS a, q.side AS b, round(coalesce(s.m, 0) / least(p.t, q.t), 9) AS overlap FROM totals p JOIN totals q ON p.side < q.side
    LEFT JOIN (SELECT x.side AS a, y.side AS b, sum(least(x.cnt, y.cnt)) AS m FROM hist x JOIN hist y ON x.key = y.key AND x.side < y.side GROUP BY 1, 2) s ON s.a = p.side AND s.b = q.side"""
)
def a5_overlap_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", words(F.col("text"), 2).alias("w"))
    grams = docs.select("source", F.explode(shingles(F.col("w"), 5)).alias("gram"))
    hist = S.histogram(grams.repartition("gram"), "source", "gram")  # few are equal in a task, so one shuffle by the gram serves the counts and the sides that share it
    return S.overlap(hist).select("a", "b", F.round("overlap", 9).alias("overlap"))


@query(
    f"""WITH {_HIST_SQL} SELECT key, coalesce(sum(cnt) FILTER (side = 'de'), 0)::BIGINT AS cnt_a, coalesce(sum(cnt) FILTER (side = 'en'), 0)::BIGINT AS cnt_b
    FROM hist WHERE side IN ('de', 'en') GROUP BY 1 ORDER BY cnt_a + cnt_b DESC, key LIMIT 6"""
)
def w3_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_terms(word_histogram(spark, sf_dir), "de", "en", 6)


@query(
    f"""WITH {_SOURCE_SETS_SQL}, holders AS (SELECT key, count(*) AS n FROM feats GROUP BY 1),
    tagged AS (SELECT key, bool_or(side = 'src0') AS x, bool_or(side = 'src1') AS y, bool_or(side = 'src2') AS z FROM feats GROUP BY 1)
    SELECT count(*) FILTER (x AND y) AS inter, count(*) FILTER (x OR y) AS united, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) FILTER (x AND y AND NOT z) AS distinctive FROM tagged"""
)
def u1_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, union, differences, and what two sides share that a third lacks; one shuffle for all of them."""
    tagged = source_words(spark, sf_dir).groupBy("key").agg(*(F.max(F.col("side") == s).alias(c) for s, c in (("src0", "x"), ("src1", "y"), ("src2", "z"))))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return tagged.agg(F.count_if(x & y).alias("inter"), F.count_if(x | y).alias("united"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(x & y & ~z).alias("distinctive"))


@query(
    r"""WITH names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT event_type || '_' || props FROM events UNION SELECT '__dunder_x' UNION SELECT 'camelCase' UNION SELECT 'short')
    SELECT name FROM names WHERE length(name) >= 6 AND NOT starts_with(name, '__') AND regexp_matches(name, '_|[a-z][A-Z]')"""
)
def x15_distinctive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", "props").alias("name"))
    extra = spark.createDataFrame([("__dunder_x",), ("camelCase",), ("short",)], "name string")
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).unionByName(events).unionByName(extra).distinct()
    return names.where(is_distinctive(F.col("name")))


@query(
    r"""WITH lines AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT DISTINCT trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS message FROM lines WHERE length(line) BETWEEN 8 AND 200 AND contains(line, ' ') AND NOT regexp_matches(line, '[\x00-\x1f\x7f]')"""
)
def x11_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(is_message(F.col("line"))).select(message(F.col("line")).alias("message")).distinct()


@query(
    f"""WITH {_SOURCE_SETS_SQL} SELECT side, count(*) AS n_words FROM feats GROUP BY 1"""
)
def x16_quirk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_words(spark, sf_dir).groupBy("side").agg(F.count(F.lit(1)).alias("n_words"))


_MEASURES = "(VALUES ('p1', 'POS', 0.5, 0.25, 0.75, 0.9), ('p2', 'POS', 0.8, CAST('nan' AS DOUBLE), 0.6, 0.7), ('n1', 'NEG', 0.1, 0.2, 0.4, CAST('nan' AS DOUBLE)), ('n2', 'NEG', CAST('nan' AS DOUBLE), 0.3, 0.5, 0.1)) t(pair, label, m1, m2, m3, m4)"


@query(
    f"""WITH t AS (SELECT pair, label, list_sort(list_filter([m1::DOUBLE, m2::DOUBLE, m3::DOUBLE, m4::DOUBLE], lambda v: NOT isnan(v))) AS v FROM {_MEASURES})
    SELECT pair, label, v[1] AS lo, v[2] AS second, v[len(v) // 2 + 1] AS upper_median, v[len(v)] AS hi, round(list_sum(v) / len(v), 9) AS combined FROM t"""
)
def a14_a15_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    nan = float("nan")
    rows = [("p1", "POS", 0.5, 0.25, 0.75, 0.9), ("p2", "POS", 0.8, nan, 0.6, 0.7), ("n1", "NEG", 0.1, 0.2, 0.4, nan), ("n2", "NEG", nan, 0.3, 0.5, 0.1)]
    df = spark.createDataFrame(rows, "pair string, label string, m1 double, m2 double, m3 double, m4 double")
    m = [F.col(f"m{i}") for i in range(1, 5)]
    lo, second, median, hi = S.envelope(*m)
    return df.select("pair", "label", lo.alias("lo"), second.alias("second"), median.alias("upper_median"), hi.alias("hi"), F.round(S.nan_mean(*m), 9).alias("combined"))
