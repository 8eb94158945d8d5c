"""Places and running totals over a whole table without a task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def running(df: DataFrame, order: Sequence[Column | str], size: str | None = None) -> DataFrame:
    """``df`` with ``place`` (from 1, in the order given, which should be total) and, if ``size`` names a column, ``total``, its
    running sum. Rows are dealt by ranges of the order and counted part by part; what stands before a part is summed over
    parts, of which there are as many as shuffle partitions."""
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, "running")  # parts stay what they are when a task runs again
    value = F.col(size) if size else F.lit(0)
    parts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"))
    inside = Window.partitionBy("__part").orderBy(*order)
    found = dealt.join(F.broadcast(parts), "__part").withColumn("place", F.col("__n") + F.row_number().over(inside))
    if size:
        found = found.withColumn("total", F.col("__s") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return found.drop("__part", "__n", "__s")
