"""Rows made on the way grow with the tables, not with their square, where few titles are shared by all."""

import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest import catalog


def write_tables(spark, folder, n):
    """n customers, who share 300 titles, with two orders each."""
    c = spark.range(n)
    c.select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer "), "id").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("MACHINERY").alias("c_mktsegment")).write.parquet(f"{folder}/customer.parquet")
    o = spark.range(2 * n)
    o.select(F.col("id").alias("o_orderkey"), (F.col("id") % n).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit(datetime.datetime(2024, 1, 1)).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def joined_rows(spark, df):
    """Rows that the joins of df make, read from the metrics of its run, and its own rows."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    n = len(df.collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made, joins = 0, 0
    runs = store.executionsList()
    for k in range(before, runs.size()):
        run = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if "Join" not in node.name():
                continue
            for j in range(node.metrics().size()):
                m = node.metrics().apply(j)
                value = values.get(m.accumulatorId())
                if m.name() == "number of output rows" and value.isDefined():
                    made, joins = made + int(value.get().replace(",", "")), joins + 1
    assert joins
    return made, n


@pytest.mark.parametrize("query", ["gated_section", "task_upsert"])
def test_joins_grow_with_the_tables(spark, tmp_path, query):
    made = {}
    for n in (1500, 6000):
        df = catalog.queries()[query](spark, write_tables(spark, tmp_path / str(n), n))
        made[n], rows = joined_rows(spark, df)
        assert rows >= n
    assert made[6000] <= 4.5 * made[1500]
