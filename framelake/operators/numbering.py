"""Dense numbers along an order of a whole table, without one task for all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import keep


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """rows with start, start + 1, ... in order; equal ones in any order.

    Rows are cut by quantiles of the order and numbered within a cut; a row a cut says how many come before it."""
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    cut = keep(cut.withColumn("__cut", F.shiftright("__at", 33)))
    counts = cut.groupBy("__cut").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__cut", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + start).alias("__shift"))
    return cut.join(shift, "__cut").withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__cut", "__shift")
