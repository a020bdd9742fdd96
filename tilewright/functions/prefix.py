"""Ranks and running sums over rows in random order, without a single-task window.

The order is a hex draw key, so its first digits cut the rows into even buckets in that order. Totals of the buckets (16 ** DIGITS
rows, however large the table) give each bucket's offset; within a bucket an ordinary window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def running_before(df: DataFrame, key: str, value: Column, name: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over rows with a smaller ``key`` (a unique hex draw key) in the same ``partition``."""
    by = [*partition, "__bucket"]
    rows = df.withColumn("__bucket", F.substring(key, 1, DIGITS)).withColumn("__value", value)
    offsets = rows.groupBy(*by).agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*(partition or (F.lit(0),))).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(*by, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(name, F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return out.join(offsets, by).withColumn(name, F.col(name) + F.col("__offset")).drop("__bucket", "__value", "__offset")


def draw_rank(df: DataFrame, key: str, name: str = "rank", partition: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its 0-based rank by draw key."""
    return running_before(df, key, F.lit(1), name, partition).withColumn(name, F.col(name).cast("long"))


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with its 0-based rank by ``order``, ties by nothing else: range partitions are written with their number, a row a partition
    gives their offsets, and windows run inside partitions."""
    from tilewright.sources.shared import written

    rows = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return rows.withColumn(name, inside).join(F.broadcast(offsets), "__part").withColumn(name, (F.col(name) + F.col("__offset")).cast("long")).drop("__part", "__offset")
