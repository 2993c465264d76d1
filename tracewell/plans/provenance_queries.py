"""Carry-over, residuals, interface verdicts, agreement of detectors, reconciliation and integrity over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.columns import QUIRK_STOP, confidence_bucket, pilot_label, report_bucket, report_label, words
from tracewell.operators import behaviour as B
from tracewell.operators import provenance as P
from tracewell.operators import similarity as S
from tracewell.plans.registry import query, table

_NORM = r"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> ''), chr(10))"


@query(
    f"""WITH h AS (SELECT DISTINCT source AS side, sha256(n) AS h FROM (SELECT source, {_NORM} AS n FROM documents) WHERE n <> ''), sizes AS (SELECT side, count(*) AS n FROM h GROUP BY 1),
    s AS (SELECT x.side AS a, y.side AS b, count(*) AS shared, array_to_string(list_slice(list_sort(list(x.h)), 1, 5), ',') AS e FROM h x JOIN h y ON x.h = y.h AND x.side < y.side GROUP BY 1, 2)
    SELECT x.side AS a, y.side AS b, x.n AS n_a, y.n AS n_b, coalesce(shared, 0) AS shared, coalesce(array_to_string(list_transform(string_split(e, ','), lambda v: v[1:12]), ','), '') AS evidence,
    CASE WHEN coalesce(shared, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM sizes x JOIN sizes y ON x.side < y.side LEFT JOIN s ON s.a = x.side AND s.b = y.side"""
)
def q1_literal_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.literal_carryover(table(spark, sf_dir, "documents").select(F.col("source").alias("side"), "text"))


@query("SELECT doc_id, n_chars, length(text)::BIGINT AS recomputed, sha256(text) AS digest, n_chars = length(text) AS agrees FROM documents")
def s5_digest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.length("text").cast("long").alias("recomputed"), F.sha2("text", 256).alias("digest"), (F.col("n_chars") == F.length("text")).alias("agrees"))


_FEATS = f"feats AS (SELECT DISTINCT source AS impl, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS feature FROM documents)"
_API = "api AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS feature FROM benchmark)"
_RESIDUAL = f"""WITH {_FEATS}, f AS (SELECT impl, feature FROM feats WHERE feature NOT IN ({", ".join(f"'{w}'" for w in sorted(set(QUIRK_STOP)))})), {_API},
    pairs AS (SELECT a.impl AS a, b.impl AS b FROM (SELECT DISTINCT impl FROM f) a JOIN (SELECT DISTINCT impl FROM f) b ON a.impl < b.impl),
    res AS (SELECT p.a, p.b, x.feature FROM pairs p JOIN f x ON x.impl = p.a JOIN f y ON y.impl = p.b AND y.feature = x.feature WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.feature = x.feature AND o.impl <> p.a AND o.impl <> p.b))"""


def _residual_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    feats = table(spark, sf_dir, "documents").select(F.col("source").alias("impl"), F.lit("word").alias("kind"), F.explode(words(F.col("text"))).alias("feature")).where(~F.col("feature").isin(QUIRK_STOP)).distinct()
    impls = table(spark, sf_dir, "documents").select("source").distinct()
    pairs = impls.select(F.col("source").alias("a")).join(impls.select(F.col("source").alias("b")), F.col("a") < F.col("b"))
    api = impls.join(table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("feature")).distinct()).select(F.col("source").alias("impl"), "feature")
    return feats, pairs, api


@query(f"{_RESIDUAL} SELECT a, b, 'word' AS kind, feature FROM res WHERE feature NOT IN (SELECT feature FROM api)")
def q15_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.residual(*_residual_words(spark, sf_dir))


@query(f"{_RESIDUAL} SELECT a, b, count(*) AS n_res, array_to_string(list_slice(list_sort(list(feature)), 1, 8), ' ') AS first_features FROM res GROUP BY 1, 2")
def a13_residual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats, pairs, _ = _residual_words(spark, sf_dir)
    found = P.residual(feats, pairs)
    first = S.first_n(found, ["a", "b"], ["feature"], 8).groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("feature")), " ").alias("first_features"))
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_res")).join(first, ["a", "b"])


@query(
    f"""WITH {_FEATS}, fam AS (SELECT impl, CASE WHEN CAST(substr(impl, 4) AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS family, feature FROM feats),
    p AS (SELECT a.impl AS a, b.impl AS b, a.family, a.n + 0 AS na, b.n + 0 AS nb FROM (SELECT impl, family, count(*) AS n FROM fam GROUP BY 1, 2) a JOIN (SELECT impl, family, count(*) AS n FROM fam GROUP BY 1, 2) b ON a.family = b.family AND a.impl < b.impl),
    s AS (SELECT x.impl AS a, y.impl AS b, count(*) AS shared FROM fam x JOIN fam y ON x.feature = y.feature AND x.impl < y.impl AND x.family = y.family GROUP BY 1, 2)
    SELECT family, count(*) AS n_pairs, round(min(shared / (na + nb - shared)), 9) AS lowest, round(max(shared / (na + nb - shared)), 9) AS highest, round(avg(shared / (na + nb - shared)), 9) AS mean FROM p JOIN s USING (a, b) GROUP BY 1"""
)
def q16_family_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of Jaccard similarities inside each family of sources."""
    docs = table(spark, sf_dir, "documents").select("source", F.explode(words(F.col("text"))).alias("key"))
    hist = docs.select(F.col("source").alias("side"), "key").distinct().withColumn("cnt", F.lit(1))
    family = lambda c: F.when(F.substring(c, 4, 9).cast("int") % 2 == 0, "even").otherwise("odd")
    found = S.jaccard(hist).withColumn("family", family("a")).where(F.col("family") == family("b"))
    return found.groupBy("family").agg(F.count(F.lit(1)).alias("n_pairs"), *(F.round(f("jaccard"), 9).alias(n) for f, n in ((F.min, "lowest"), (F.max, "highest"), (F.avg, "mean"))))


# two detectors of a document's kind, as rules over its columns; labels are spelt differently
_ENC_A = "CASE lang WHEN 'en' THEN 'WINDOWS-1252' WHEN 'de' THEN 'latin-1' WHEN 'fr' THEN 'SHIFT_JIS' ELSE 'utf8' END"
_ENC_B = "CASE WHEN n_chars % 7 = 0 THEN 'ERR: x' WHEN lang = 'en' THEN 'ascii' WHEN lang = 'de' THEN 'iso8859-1' WHEN lang = 'fr' THEN 'cp932' ELSE 'UTF_8' END"
_CONF_A = "CASE WHEN n_chars % 11 = 0 THEN NULL ELSE CAST((n_chars % 21) AS DOUBLE) / 20 END"
_CONF_B = "CASE WHEN n_chars % 13 = 0 THEN NULL ELSE CAST((n_chars % 20) AS DOUBLE) / 20 END"


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang <> 'xx'")
    out = None
    for impl, enc, conf in (("a", _ENC_A, _CONF_A), ("b", _ENC_B, _CONF_B)):
        part = docs.select(F.lit(impl).alias("impl"), F.when(F.col("doc_id") % 2 == 0, "easy").otherwise("hard").alias("workload"), F.col("lang").alias("bucket"), F.col("doc_id").alias("item"), F.expr(enc).alias("enc"), F.expr(conf).alias("conf"))
        out = part if out is None else out.unionByName(part)
    return out


_BUCKET = "CASE WHEN {0} IS NULL THEN 'none' WHEN {0} >= 0.9 THEN 'high' WHEN {0} >= 0.5 THEN 'med' ELSE 'low' END"
_LABELS = "(VALUES ('cp1252', 'windows-1252'), ('latin-1', 'iso-8859-1'), ('shift-jis', 'shift_jis'), ('sjis', 'shift_jis'), ('cp932', 'shift_jis'), ('gb2312', 'gb18030'), ('gbk', 'gb18030'), ('utf8', 'utf-8')) v(k, t)"
_PILOT = "(VALUES ('utf8', 'utf-8'), ('latin1', 'iso-8859-1'), ('latin-1', 'iso-8859-1'), ('iso8859-1', 'iso-8859-1'), ('cp1252', 'windows-1252'), ('us-ascii', 'ascii'), ('gb2312', 'gb18030'), ('gbk', 'gb18030'), ('sjis', 'shift-jis'), ('shiftjis', 'shift-jis')) v(k, t)"


def _fold_sql(x: str) -> str:
    return f"coalesce((SELECT t FROM {_LABELS} WHERE k = lower(trim({x}))), lower(trim({x})))"


def _pilot_sql(x: str) -> str:
    key = f"replace(replace(lower({x}), '_', '-'), ' ', '')"
    return f"CASE WHEN {x} IS NULL OR {x} = '' OR starts_with({x}, 'ERR') THEN {x} ELSE coalesce((SELECT t FROM {_PILOT} WHERE k = {key}), {key}) END"


_DETECTED = f"""d AS (SELECT doc_id AS item, lang AS bucket, CASE WHEN doc_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS workload, {_ENC_A} AS enc_a, {_CONF_A} AS conf_a, {_ENC_B} AS enc_b, {_CONF_B} AS conf_b FROM documents),
    f AS (SELECT *, {_fold_sql("enc_a")} AS fa, {_fold_sql("enc_b")} AS fb, {_BUCKET.format("conf_a")} AS ba, {_BUCKET.format("conf_b")} AS bb, {_pilot_sql("enc_a")} AS pa, {_pilot_sql("enc_b")} AS pb FROM d),
    g AS (SELECT *, CASE WHEN ba = 'high' AND fa IN ('ascii', 'windows-1252', 'iso-8859-1') THEN 'ascii_or_latin_family' ELSE fa END AS na, CASE WHEN bb = 'high' AND fb IN ('ascii', 'windows-1252', 'iso-8859-1') THEN 'ascii_or_latin_family' ELSE fb END AS nb FROM f),
    h AS (SELECT *, enc_a IS NOT DISTINCT FROM enc_b AND conf_a IS NOT DISTINCT FROM conf_b AS e, enc_a IS NOT DISTINCT FROM enc_b AND ba = bb AS u, na IS NOT DISTINCT FROM nb AND ba = bb AS m FROM g)"""


@query(
    f"""WITH {_DETECTED} SELECT item, fa AS report_a, na AS bucket_a, ba AS confidence_a, pb AS pilot_b FROM h"""
)
def p5_p8_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = B.paired(detected(spark, sf_dir), "a", "b")
    ea, ca = F.col("enc_a"), F.col("conf_a")
    return pairs.select("item", report_label(ea).alias("report_a"), report_bucket(ea, ca).alias("bucket_a"), confidence_bucket(ca).alias("confidence_a"), pilot_label(F.col("enc_b")).alias("pilot_b"))


@query(
    f"""WITH {_DETECTED} SELECT bucket, count(*) FILTER (e) AS exact, count(*) FILTER (u) AS bucketed, count(*) FILTER (m) AS normalised, count(*) AS n, count(*) FILTER (e) / count(*) AS exact_rate,
    count(*) FILTER (u) / count(*) AS bucketed_rate, count(*) FILTER (m) / count(*) AS normalised_rate FROM h GROUP BY GROUPING SETS ((bucket), ())"""
)
def q7_agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.report(B.paired(detected(spark, sf_dir), "a", "b"))


@query(f"WITH {_DETECTED}, r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY item) AS i FROM h WHERE NOT e) SELECT bucket, item, enc_a, conf_a, enc_b, conf_b, m AS normalised_agree FROM r WHERE i <= 5")
def a11_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.samples(B.paired(detected(spark, sf_dir), "a", "b"))


@query(f"WITH {_DETECTED} SELECT workload, count(*) AS n, round(avg((pa IS NOT DISTINCT FROM pb)::INT), 9) AS agreement, count(*) FILTER (pa IS DISTINCT FROM pb) AS discriminating FROM h GROUP BY 1")
def q11_pilot_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detected(spark, sf_dir)
    told = B.discriminating(found, 2).groupBy("workload").agg(F.count(F.lit(1)).alias("discriminating"))
    return B.agreement(B.paired(found, "a", "b")).join(told, "workload", "left").select("workload", "n", F.round("agreement", 9).alias("agreement"), F.coalesce("discriminating", F.lit(0)).alias("discriminating"))


@query(
    f"""WITH {_DETECTED}, c AS (SELECT * FROM h WHERE conf_a IS NOT NULL AND conf_b IS NOT NULL AND pa IS NOT DISTINCT FROM pb), va AS (SELECT DISTINCT enc_a AS k FROM h WHERE NOT starts_with(enc_a, 'ERR')), vb AS (SELECT DISTINCT enc_b AS k FROM h WHERE NOT starts_with(enc_b, 'ERR'))
    SELECT (SELECT count(*) FROM c) AS n, (SELECT round(avg((abs(conf_a - conf_b) <= 0.05)::INT), 9) FROM c) AS conf_agreement, (SELECT count(*) FROM va JOIN vb USING (k)) AS shared_labels, (SELECT count(*) FROM va) AS labels_a, (SELECT count(*) FROM vb) AS labels_b"""
)
def q12_confidence_and_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detected(spark, sf_dir)
    conf = B.confidence_agreement(B.paired(found, "a", "b"))
    words_of = B.vocabulary(found).groupBy("key").agg(F.max(F.col("side") == "a").alias("x"), F.max(F.col("side") == "b").alias("y"))
    sets = words_of.agg(F.count_if(F.col("x") & F.col("y")).alias("shared_labels"), F.count_if("x").alias("labels_a"), F.count_if("y").alias("labels_b"))
    return conf.select("n", F.round("agreement", 9).alias("conf_agreement")).join(sets)


@query(f"WITH {_DETECTED} SELECT count(*) FILTER (m) AS normalised, count(*) AS n, count(*) FILTER (m) / count(*) AS rate FROM h WHERE bucket <> 'es'")
def a32_realistic_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.realistic_rate(B.report(B.paired(detected(spark, sf_dir), "a", "b")), control="es")



@query(
    """WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS method FROM orders), m AS (SELECT o_custkey % 2 AS side, o_orderpriority AS cls, method, count(*) % 2 AS args, count(DISTINCT o_orderstatus) AS kw, min(o_custkey % 3) AS name FROM o
    WHERE NOT (o_custkey % 2 = 0 AND o_orderpriority = '5-LOW') AND NOT (o_custkey % 2 = 1 AND o_orderpriority = '1-URGENT') GROUP BY 1, 2, 3),
    b AS (SELECT coalesce(x.cls, y.cls) AS cls, CASE WHEN y.cls IS NULL THEN 'removed' WHEN x.cls IS NULL THEN 'added' WHEN x.args = y.args AND x.kw = y.kw AND x.name = y.name THEN 'strict' WHEN x.args = y.args AND x.kw = y.kw THEN 'renamed_args' ELSE 'diverged' END AS v,
    x.cls IS NOT NULL AS ina, y.cls IS NOT NULL AS inb FROM (SELECT * FROM m WHERE side = 0) x FULL JOIN (SELECT * FROM m WHERE side = 1) y ON x.cls = y.cls AND x.method = y.method),
    c AS (SELECT cls, count(*) FILTER (v = 'strict') AS strict, count(*) FILTER (v = 'renamed_args') AS renamed_args, count(*) FILTER (v = 'diverged') AS diverged, count(*) FILTER (v = 'removed') AS removed, count(*) FILTER (v = 'added') AS added, bool_or(ina) AS ina, bool_or(inb) AS inb FROM b GROUP BY 1)
    SELECT cls, strict, renamed_args, diverged, removed, added, CASE WHEN NOT inb THEN 'removed_class' WHEN NOT ina THEN 'added_class' WHEN removed + added + diverged > 0 THEN 'diverged' WHEN renamed_args > 0 THEN 'renamed_args' ELSE 'strict' END AS verdict FROM c"""
)
def q6_class_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as classes, their months as methods, customers of even and odd keys as the two sides."""
    orders = table(spark, sf_dir, "orders").withColumn("side", F.col("o_custkey") % 2)
    orders = orders.where(~((F.col("side") == 0) & (F.col("o_orderpriority") == "5-LOW")) & ~((F.col("side") == 1) & (F.col("o_orderpriority") == "1-URGENT")))
    m = orders.groupBy("side", F.col("o_orderpriority").alias("cls"), F.date_format("o_orderdate", "yyyy-MM").alias("method"))
    m = m.agg((F.count(F.lit(1)) % 2).alias("args"), F.count_distinct("o_orderstatus").alias("kw"), F.min(F.col("o_custkey") % 3).alias("name"))
    m = m.select("side", "cls", "method", F.struct("args", "kw", "name").alias("d"))
    return P.class_verdicts(m.where("side = 0"), m.where("side = 1"), ["args", "kw"])


@query(
    """WITH a AS (SELECT l_returnflag || l_linestatus AS name, round(sum(l_extendedprice), 2) AS x FROM lineitem GROUP BY 1 UNION ALL SELECT 'only_a', 1.0), b AS (SELECT l_returnflag || l_linestatus AS name, round(sum(l_extendedprice * (CASE WHEN l_returnflag = 'N' THEN 1.01 ELSE 1 END)), 2) AS y FROM lineitem GROUP BY 1 UNION ALL SELECT 'only_b', 1.0)
    SELECT name, coalesce(abs(x - y) <= 0.001, false) AS agrees FROM a FULL JOIN b USING (name)"""
)
def j18_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum by two routes, one of which errs for a flag, and a name that one side lacks."""
    lines = table(spark, sf_dir, "lineitem").withColumn("name", F.concat("l_returnflag", "l_linestatus"))
    a = lines.groupBy("name").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    b = lines.groupBy("name").agg(F.round(F.sum(F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "N", 1.01).otherwise(1.0)), 2).alias("value"))
    only = lambda n: spark.createDataFrame([(n, 1.0)], "name string, value double")
    return P.reconcile(a.unionByName(only("only_a")), b.unionByName(only("only_b"))).select("name", "agrees")


@query(
    """WITH m AS (SELECT l_shipmode AS name, sum(q) AS v FROM (SELECT l_returnflag AS l_shipmode, CAST(l_quantity AS DECIMAL(20,4)) / 8 AS q FROM lineitem) GROUP BY 1) SELECT l_returnflag AS name, true AS agrees FROM lineitem GROUP BY 1 UNION ALL SELECT 'wrong', false"""
)
def j19_displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displayed decimals, taken from a text, against exact sums; one is wrong on purpose."""
    exact = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg((F.sum(F.col("l_quantity").cast("decimal(20,4)")) / 8).cast("decimal(28,12)").alias("value"))
    measured = exact.unionByName(spark.createDataFrame([("wrong", 0.6665)], "name string, value double").select("name", F.col("value").cast("decimal(28,12)")))
    text = exact.select("name", F.concat(F.lit("value="), F.round("value", 3).cast("decimal(28,3)").cast("string"), F.lit(" units")).alias("text")).unionByName(spark.createDataFrame([("wrong", "value=0.666 units")], "name string, text string"))
    shown = text.select("name", F.regexp_extract("text", r"value=([0-9.]+)", 1).alias("value"))
    return P.displayed(measured, shown).select("name", "agrees")


@query("""SELECT 'orders' AS src, 'customer' AS rel, o_custkey::VARCHAR AS dst FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)""")
def j20_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.lit("orders").alias("src"), F.lit("customer").alias("rel"), F.col("o_custkey").cast("string").alias("dst"))
    return P.dangling(links, table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("id")))


@query(
    """WITH links AS (SELECT p_brand AS claim, s.s_nationkey AS evidence FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l JOIN part ON p_partkey = l_partkey JOIN supplier s ON s_suppkey = l_suppkey)
    SELECT 'claim' AS kind, b.id, count(l.claim) AS links FROM (SELECT DISTINCT p_brand AS id FROM part) b LEFT JOIN links l ON l.claim = b.id GROUP BY 1, 2 UNION ALL SELECT 'evidence', n_nationkey::VARCHAR, count(l.evidence) FROM nation LEFT JOIN links l ON l.evidence = n_nationkey GROUP BY 1, 2"""
)
def a29_evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    links = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("p_brand").alias("claim_id"), F.col("s_nationkey").cast("string").alias("evidence_id"))
    return P.evidence_coverage(part.select(F.col("p_brand").alias("id")).distinct(), table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id")), links)


@query("SELECT o_orderstatus AS verdict, count(*) AS n FROM orders GROUP BY 1")
def a18_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.verdict_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("PIVOT (SELECT event_type AS signal, 'm' || month(ts) AS pair, value FROM events WHERE month(ts) IN (1, 2, 3)) ON pair IN ('m1', 'm2', 'm3') USING round(avg(value), 6) GROUP BY signal")
def k5_signal_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of signals by pairs."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("signal"), F.concat(F.lit("m"), F.month("ts")).alias("pair"), "value")
    return rows.groupBy("signal").pivot("pair", ["m1", "m2", "m3"]).agg(F.round(F.avg("value"), 6))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE (doc_id % 3 = 0)::INT END AS code, text AS out, CASE WHEN doc_id % 4 = 0 THEN upper(text) ELSE text END AS want FROM documents)
    SELECT CASE WHEN code IS NULL THEN 'SKIP' WHEN code = 0 AND out = want THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS n FROM r GROUP BY 1""")
def q25_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-exact contracts: exit codes and outputs made from documents."""
    d = table(spark, sf_dir, "documents")
    code = F.when(F.col("doc_id") % 10 != 0, (F.col("doc_id") % 3 == 0).cast("int"))
    want = F.when(F.col("doc_id") % 4 == 0, F.upper("text")).otherwise(F.col("text"))
    outcome = P.contract_outcome(code, F.col("text").cast("binary"), want.cast("binary"), F.lit(""))
    return P.verdict_counts(d.select(outcome.alias("verdict")))


@query(r"""SELECT doc_id, regexp_matches(regexp_replace(text, '[|][^\n]*', '', 'g'), '[Tt]h') AS has_th, regexp_matches(regexp_replace(text, '[|][^\n]*', '', 'g'), '!!') AS shouts FROM documents""")
def p14_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of a text whose comments (from a bar to the line's end) are left out."""
    return table(spark, sf_dir, "documents").select("doc_id", P.profile(F.col("text"), {"has_th": "[Tt]h", "shouts": "!!"}, comment="[|]").alias("p")).select("doc_id", "p.*")


@query("SELECT source AS node, count(DISTINCT word) FILTER (regexp_matches(word, '^th')) AS th, count(DISTINCT word) FILTER (regexp_matches(word, 'ing$')) AS ing FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) GROUP BY 1")
def a30_marker_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "documents").select(F.col("source").alias("node"), F.explode(words(F.col("text"))).alias("symbol"))
    return P.marker_survival(symbols, {"th": "^th", "ing": "ing$"})
