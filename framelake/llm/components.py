"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by and a join on the same key; steps are written to the shared folder, which cuts the
lineage. Stars replace chains, so the number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges with m of their end a. The key is not the one that low is grouped by, so that a node with very many edges can be dealt to several tasks."""
    low = low.select(F.bitwise_not("a").alias("k"), "m")
    return edges.withColumn("k", F.bitwise_not("a")).join(low, "k").select("a", "b", "m")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """id, component (the smallest id that can be reached): a row for each node of edges (a, b) that is not its component's smallest.

    Null ends, loops and repeated edges add nothing; no edges give no rows."""
    e = keep(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b and a is not null and b is not null").distinct(), narrow=True)
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _with_low(both, low).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_low(large, low).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct()
        new = keep(spark, small, narrow=True)
        new_mark = _mark(new)
        drop(spark, e)
        e = new
        if new_mark == mark:
            break
        mark = new_mark
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
