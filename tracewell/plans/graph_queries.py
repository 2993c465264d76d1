"""Graphs of the trade tables: topology, Weisfeiler-Lehman labels, strong components, degrees and DAGs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import degree_bucket
from tracewell.operators import graph as G
from tracewell.operators import provenance as P
from tracewell.operators import similarity as S
from tracewell.operators.lineage import cut
from tracewell.plans.registry import query, table

_TRADE = """t AS (SELECT o_orderpriority AS g, c_nationkey::VARCHAR AS src, s_nationkey::VARCHAR AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
    sums AS (SELECT *, sum(n) OVER (PARTITION BY g) AS every, sum(n) OVER (PARTITION BY g, src) AS n_src, sum(n) OVER (PARTITION BY g, dst) AS n_dst FROM t), edges AS (SELECT g, src, dst FROM sums WHERE n * every > n_src * n_dst),
    nodes AS (SELECT g, src AS id FROM edges UNION SELECT g, dst FROM edges),
    deg AS (SELECT n.g, n.id, (SELECT count(*) FROM edges e WHERE e.g = n.g AND e.dst = n.id) AS n_in, (SELECT count(*) FROM edges e WHERE e.g = n.g AND e.src = n.id) AS n_out FROM nodes n)"""


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph for each order priority: the flows from a customer's to a supplier's nation that are larger than the two nations' shares of all flows explain."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier")}
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderpriority").join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "c_nationkey")
    # nations come before the join of lines and orders: its result, as long as lineitem, is counted where it is and not shuffled by customer or supplier
    lines = t["lineitem"].select("l_orderkey", "l_suppkey").join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.select("l_orderkey", "s_nationkey").join(orders, "l_orderkey")
    flows = lines.groupBy(F.col("o_orderpriority").alias("g"), F.col("c_nationkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("g", *by))
    edges = flows.withColumns({"every": total(), "n_src": total("src"), "n_dst": total("dst")}).where("n * every > n_src * n_dst").select("g", "src", "dst")
    edges = cut(edges)  # rounds read the edges many times
    return G.merge(edges.select("g", F.col("src").alias("id")), edges)


#: For each node its strong component, by the closure of the edges.
_STRONG = """reach AS (SELECT g, src, dst FROM edges UNION SELECT r.g, r.src, e.dst FROM reach r JOIN edges e ON e.g = r.g AND e.src = r.dst),
    strong AS (SELECT n.g, n.id, least(n.id, coalesce(min(r.dst), n.id)) AS component FROM nodes n LEFT JOIN (SELECT r.* FROM reach r JOIN reach b ON b.g = r.g AND b.src = r.dst AND b.dst = r.src) r ON r.g = n.g AND r.src = n.id GROUP BY 1, 2),
    sccs AS (SELECT g, count(DISTINCT component) AS sccs FROM strong GROUP BY 1)"""


@query(
    f"""WITH RECURSIVE {_TRADE}, {_STRONG} SELECT g, count(*) AS nodes, sum(n_out)::BIGINT AS edges, any_value(sccs) AS sccs, round(avg(n_in), 9) AS mean_in, round(avg(n_out), 9) AS mean_out, max(n_in) AS max_in, max(n_out) AS max_out, round(sum(n_out) / (count(*) * (count(*) - 1)), 9) AS density FROM deg JOIN sccs USING (g) GROUP BY 1"""
)
def a6_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.topology(*trade(spark, sf_dir))
    return t.select("g", "nodes", "edges", "sccs", *(F.round(c, 9).alias(c) for c in ("mean_in", "mean_out")), "max_in", "max_out", F.round("density", 9).alias("density"))


_FEATURES = ["nodes", "edges", "density", "sccs", "mean_in", "mean_out", "max_in", "max_out"]


@query(
    f"""WITH RECURSIVE {_TRADE}, {_STRONG}, f AS (SELECT g, count(*) AS nodes, sum(n_out) AS edges, any_value(sccs) AS sccs, avg(n_in) AS mean_in, avg(n_out) AS mean_out, max(n_in) AS max_in, max(n_out) AS max_out, sum(n_out) / (count(*) * (count(*) - 1)) AS density FROM deg JOIN sccs USING (g) GROUP BY 1)
    SELECT x.g AS a, y.g AS b, round(1 - ({" + ".join(f"CASE WHEN x.{c} = 0 AND y.{c} = 0 THEN 0 ELSE abs(x.{c} - y.{c}) / (abs(x.{c}) + abs(y.{c})) END" for c in _FEATURES)}) / {len(_FEATURES)}, 9) AS similarity FROM f x JOIN f y ON x.g < y.g"""
)
def q2_topology_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.feature_similarity(G.topology(*trade(spark, sf_dir)), "g", _FEATURES).select("a", "b", F.round("similarity", 9).alias("similarity"))


def _wl_sql(successors: bool) -> str:
    label = "n_in || '_' || n_out" if successors else "'d:' || n_in || '|' || n_out"
    ctes = [f"l0 AS (SELECT g, id, {label} AS label FROM deg)"]
    for i in (1, 2, 3, 4):
        ins = "" if successors else f"|| '||' || coalesce((SELECT array_to_string(list_sort(list(x.label)), ',') FROM edges e JOIN l{i - 1} x ON x.g = e.g AND x.id = e.src WHERE e.g = l.g AND e.dst = l.id), '')"
        ctes.append(f"l{i} AS (SELECT g, id, substr(sha256(l.label {ins} || '||' || coalesce((SELECT array_to_string(list_sort(list(x.label)), ',') FROM edges e JOIN l{i - 1} x ON x.g = e.g AND x.id = e.dst WHERE e.g = l.g AND e.src = l.id), '')), 1, 16) AS label FROM l{i - 1} l)")
    every = " UNION ALL ".join(f"SELECT g, {i} AS iter, label FROM l{i}" for i in range(5))
    return f"""WITH {_TRADE}, {", ".join(ctes)}, h AS (SELECT g AS side, iter, label AS key, count(*) AS cnt FROM ({every}) GROUP BY 1, 2, 3), norms AS (SELECT side, sqrt(sum(cnt * cnt)) AS n FROM h GROUP BY 1)
    SELECT x.side AS a, y.side AS b, round(coalesce((SELECT sum(p.cnt * q.cnt) FROM h p JOIN h q ON p.key = q.key AND p.iter = q.iter WHERE p.side = x.side AND q.side = y.side), 0) / x.n / y.n, 9) AS cosine FROM norms x JOIN norms y ON x.side < y.side"""


def _wl_cosine(spark: SparkSession, sf_dir: str, successors: bool) -> DataFrame:
    labels = G.wl_labels(*trade(spark, sf_dir), rounds=4, successors_only=successors)
    hist = S.histogram(labels.withColumn("key", F.concat_ws(":", "iter", "label")), "g", "key")
    return S.cosine(hist).select("a", "b", F.round("cosine", 9).alias("cosine"))


@query(_wl_sql(False))
def q3_wl_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wl_cosine(spark, sf_dir, False)


@query(_wl_sql(True))
def g5_wl_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wl_cosine(spark, sf_dir, True)


@query(
    f"""WITH RECURSIVE {_TRADE}, {_STRONG} SELECT g, id, component FROM strong"""
)
def g6_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strong_components(*trade(spark, sf_dir))


@query(
    """WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), d AS (SELECT p_partkey, count(s) AS degree FROM part LEFT JOIN e ON p = p_partkey GROUP BY 1)
    SELECT CASE WHEN degree = 0 THEN 0 ELSE floor(log2(degree))::INT + 1 END AS bucket, count(*) AS n FROM d GROUP BY 1"""
)
def p9_degree_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the number of their suppliers."""
    degree = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.count(F.lit(1)).alias("degree"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")).join(degree, "l_partkey", "left")
    return parts.groupBy(degree_bucket(F.coalesce("degree", F.lit(0))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


#: Units of a small plan: id, layer, estimated lines, what it depends on.
UNITS = [("U01", 40, []), ("U02", 55, ["U01"]), ("U03", 30, ["U01"]), ("U04", 70, ["U02", "U03"]), ("U05", 20, []), ("U06", 90, ["U04", "U05"]), ("U07", 15, ["U03"])]
_UNITS_SQL = ", ".join(f"('{u}', {n}, {d if d else '[]::VARCHAR[]'})" for u, n, d in UNITS)
_DAG = f"""u AS (SELECT * FROM (VALUES {_UNITS_SQL}) t(id, loc, deps)), d AS (SELECT id, unnest(deps) AS dep FROM u),
    walk AS (SELECT id, 0 AS layer, loc::BIGINT AS weight, id AS path FROM u WHERE len(deps) = 0 UNION ALL SELECT d.id, w.layer + 1, w.weight + u.loc, w.path || ',' || d.id FROM walk w JOIN d ON d.dep = w.id JOIN u ON u.id = d.id)"""


def units(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = spark.createDataFrame(UNITS, "id string, loc long, deps array<string>").withColumn("g", F.lit("plan"))
    return rows.select("g", "id", "loc"), rows.select("g", "id", F.explode("deps").alias("on"))


@query(f"WITH RECURSIVE {_DAG} SELECT id, max(layer) AS layer, max(weight) AS weight, arg_max(path, weight) AS path FROM walk GROUP BY 1")
def g7_critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.longest_paths(*units(spark))
    return found.select("id", "layer", "weight", F.array_join("path", ",").alias("path"))


@query(f"WITH RECURSIVE {_DAG}, l AS (SELECT id, max(layer) AS layer FROM walk GROUP BY 1) SELECT layer, count(*) AS units, sum(loc)::BIGINT AS loc, count(*) FILTER (len(deps) = 0) AS entry_points, count(*) FILTER (u.id NOT IN (SELECT dep FROM d)) AS leaves FROM u JOIN l USING (id) GROUP BY 1")
def a28_plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, depends = units(spark)
    layers = G.longest_paths(rows, depends).select("id", "layer")
    blocked = depends.select(F.col("on").alias("id"), F.lit(1).alias("blocks")).distinct()
    waits = depends.select("id", F.lit(1).alias("waits")).distinct()
    every = rows.join(layers, "id").join(blocked, "id", "left").join(waits, "id", "left")
    return every.groupBy("layer").agg(F.count(F.lit(1)).alias("units"), F.sum("loc").alias("loc"), F.count_if(F.col("waits").isNull()).alias("entry_points"), F.count_if(F.col("blocks").isNull()).alias("leaves"))


@query("""SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS "on" FROM orders WHERE o_orderstatus <> 'F'""")
def j20_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies without a matching `blocks` entry."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("on"), "o_orderstatus")
    blocks = orders.where("o_orderstatus = 'F'").select(F.col("on").alias("id"), F.col("id").alias("blocked"))
    return P.asymmetric(orders.select("id", "on"), blocks)


@query(f"WITH {_TRADE} SELECT g, count(*) AS nodes, sum(n_out)::BIGINT AS edges, round(sum(n_out) / count(*), 9) AS edges_a_node FROM deg GROUP BY 1")
def g8_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.degrees(*trade(spark, sf_dir)).groupBy("g").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n_out").alias("edges"))
    return t.select("g", "nodes", "edges", F.round(F.col("edges") / F.col("nodes"), 9).alias("edges_a_node"))


@query("SELECT c_nationkey AS caller, count(*) AS n, count(DISTINCT o_custkey) AS callers FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def q27_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls a symbol: a filter on the edge relation, with the callers counted."""
    edges = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return edges.groupBy(F.col("c_nationkey").alias("caller")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("callers"))
