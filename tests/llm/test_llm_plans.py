"""Shapes that must survive a hot group."""

from pyspark.sql import functions as F

from quern.llm import kmv, orders

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketches_are_cut_before_the_shuffle(spark):
    text = plan(kmv.sketch(spark.range(100).select((F.col("id") % 3).alias("g"), "id"), ["g"], ["id"]))
    lowest = text.rindex("Exchange hashpartitioning")
    assert "MapInArrow" in text[lowest:] and "Window" not in text[lowest:]


def test_no_products(spark):
    for query in (orders.p1_found, orders.p2_distinct, orders.p3_percentiles):
        text = plan(query(spark, DATA))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
