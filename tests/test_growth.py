"""Work is done once: plans that don't repeat a table's join or an expression."""

from pyspark.sql import functions as F
from test_oracles import SF
from test_plans import plan

from tracewell.functions import columns as C
from tracewell.plans import graph_queries


def test_rounds_over_the_trade_graph_do_not_join_the_tables_again(spark):
    nodes, edges = graph_queries.trade(spark, SF)
    assert "l_orderkey" not in plan(edges) and "l_orderkey" not in plan(nodes)


def test_items_of_shingles_are_worked_out_once(spark):
    texts = spark.createDataFrame([("ab cd ef gh",), ("ab",), (None,)], "text string")
    df = texts.select(C.words(F.col("text"), 2).alias("w")).select(C.shingles(F.col("w"), 3).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.s for r in df.collect()] == [["ab cd ef", "cd ef gh"], [], []]
