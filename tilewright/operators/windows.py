"""Order-dependent operators: islands, assignment, batches, first rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_islands(df: DataFrame, by: list[str], start: str, end: Column, order: list[str | Column], max_gap: float) -> DataFrame:
    """``df`` with island: a new one begins where the gap to the previous row's end is over ``max_gap``. From 0 in each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    gap = F.col(start) - F.lag(end).over(w)
    flagged = df.withColumn("__new", F.coalesce((gap > max_gap).cast("int"), F.lit(0)))
    return flagged.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def first_rows(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def round_robin(uses: DataFrame, pool: DataFrame, by: list[str], use_order: list[str], pool_order: list[str]) -> DataFrame:
    """``uses`` joined to ``pool``: the k-th use of a group takes the (k mod n)-th of its n pool rows."""
    size = pool.groupBy(*by).agg(F.count("*").alias("__n"))
    places = pool.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*pool_order)) - 1)
    turns = uses.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*use_order)) - 1)
    return turns.join(size, by).withColumn("__at", F.pmod("__k", "__n")).join(places, [*by, "__at"]).drop("__at", "__k", "__n")


def batches(df: DataFrame, by: list[str], order: list[str], size: int, hosts: int) -> DataFrame:
    """``df`` with batch (runs of ``size`` rows in order) and host (batch mod ``hosts``)."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(k / size).cast("long")).withColumn("host", F.pmod("batch", F.lit(hosts)))


def top_per_source(df: DataFrame, source: str, order: list[Column], n: int) -> DataFrame:
    """The ``n`` best rows, one a source (a report's pick)."""
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").orderBy(*order).limit(n)


def coverage_pick(rows: list[tuple[str, set]], most: int = 8, free: int = 4) -> list[str]:
    """Ids in order: the first ``free`` as they come, then those that add a class, ``most`` at most. For a report's few candidates."""
    picked, seen = [], set()
    for i, classes in rows:
        if len(picked) == most:
            break
        if len(picked) < free or classes - seen:
            picked.append(i)
            seen |= classes
    return picked
