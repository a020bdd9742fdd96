"""Class rebalancing: repeat factors, equal views, class tables, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def class_sets(rows: DataFrame, tile: str, cls: str) -> DataFrame:
    """(tile, classes): the sorted distinct non-null classes of each tile."""
    return rows.groupBy(tile).agg(F.array_sort(F.collect_set(cls)).alias("classes"))


def repeat_factors(sets: DataFrame, t: float) -> DataFrame:
    """``sets`` with factor: the largest max(1, sqrt(t / share)) over a tile's classes, 1 without a class."""
    n = sets.agg(F.count("*").alias("__n"))
    per = sets.select(F.explode("classes").alias("cls")).groupBy("cls").agg(F.count("*").alias("__c")).crossJoin(F.broadcast(n))
    per = per.select("cls", F.greatest(F.lit(1.0), F.sqrt(F.lit(t) / (F.col("__c") / F.col("__n")))).alias("__r"))
    # tiles share few class sets, so the maximum is taken once a set, not once a tile
    kinds = sets.select("classes").distinct()
    best = kinds.select("classes", F.explode("classes").alias("cls")).join(per, "cls").groupBy("classes").agg(F.max("__r").alias("__f"))
    return sets.join(best, "classes", "left").withColumn("factor", F.coalesce("__f", F.lit(1.0))).drop("__f")


def equal_target(counts: DataFrame, how: str) -> float:
    """The target from class counts (cls, n): ``max``, ``second`` largest (the largest if alone), or a positive whole number."""
    if how in ("max", "second"):
        top = [r.n for r in counts.orderBy(F.desc("n")).limit(2).collect()]
        if not top:
            return 0.0
        return float(top[-1] if how == "second" else top[0])
    if how.isdigit() and int(how) > 0:
        return float(how)
    raise ValueError(f"target must be max, second or a positive whole number, not {how!r}")


def equal_class_factors(kinds: list[tuple[tuple, int]], target: float, rounds: int = 500, tolerance: float = 1e-9) -> dict:
    """Factor of each class so that all have ``target`` views. ``kinds``: class sets and how many tiles have each.

    A tile is viewed as often as the largest factor of its classes; factors may be below 1.
    """
    classes = sorted({c for s, _ in kinds for c in s})
    have = {c: sum(n for s, n in kinds if c in s) for c in classes}
    factor = {c: target / have[c] for c in classes}
    for _ in range(rounds):
        views = {c: sum(n * max(factor[k] for k in s) for s, n in kinds if c in s) for c in classes}
        if all(abs(v - target) <= tolerance * target for v in views.values()):
            break
        factor = {c: factor[c] * target / views[c] for c in classes}
    return factor


def equal_factors(sets: DataFrame, how: str = "max") -> DataFrame:
    """``sets`` with factor for equal views of all classes, 1 without a class.

    The loop runs on the driver over the distinct class sets and their counts, at most 2 ** classes rows whatever the data's size.
    """
    spark: SparkSession = sets.sparkSession
    kinds = [(tuple(r.classes), r.n) for r in sets.groupBy("classes").agg(F.count("*").alias("n")).collect()]
    filled = [(s, n) for s, n in kinds if s]
    per = sets.select(F.explode("classes").alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))
    factor = equal_class_factors(filled, equal_target(per, how)) if filled else {}
    table = spark.createDataFrame([(list(s), max(factor[c] for c in s) if s else 1.0) for s, _ in kinds], StructType([sets.schema["classes"], StructField("factor", DoubleType())]))
    return sets.join(F.broadcast(table), "classes")  # one row a class set


def class_table(sets: DataFrame, classes: DataFrame, copies: Column) -> DataFrame:
    """For every row of ``classes`` (cls): tiles, share, views and multiplier (null without tiles)."""
    n = sets.agg(F.count("*").alias("__n"))
    per = sets.select(F.explode("classes").alias("cls"), copies.alias("__v")).groupBy("cls").agg(F.count("*").alias("tiles"), F.sum("__v").alias("views"))
    out = classes.join(per, "cls", "left").crossJoin(F.broadcast(n))
    return out.select(
        "cls",
        F.coalesce("tiles", F.lit(0)).cast("long").alias("tiles"),
        F.round(F.coalesce(F.try_divide("tiles", "__n"), F.lit(0.0)), 6).alias("share"),
        F.coalesce(F.col("views").cast("double"), F.lit(0.0)).alias("views"),
        F.round(F.try_divide(F.col("views").cast("double"), F.col("tiles")), 6).alias("multiplier"),
    )


def views_spread(table: DataFrame) -> DataFrame:
    """(max - min) / max of the views of classes that have tiles; 0 without any."""
    have = table.where("tiles > 0").agg(F.max("views").alias("hi"), F.min("views").alias("lo"))
    return have.select(F.round(F.coalesce(F.try_divide(F.col("hi") - F.col("lo"), F.col("hi")), F.lit(0.0)), 6).alias("spread"))


def budget(boxes: DataFrame, tile: str, cls: str, t: float) -> DataFrame:
    """For each class: tiles, boxes, share of tiles, repeat factor's expected views, boxes a tile, and tiles to add to reach them."""
    sets = repeat_factors(class_sets(boxes, tile, cls), t)
    n = sets.agg(F.count("*").alias("__n"))
    per = sets.select(F.explode("classes").alias("cls"), "factor").groupBy("cls").agg(F.count("*").cast("long").alias("tiles"), F.sum("factor").alias("__views"))
    count = boxes.groupBy(F.col(cls).alias("cls")).agg(F.count("*").cast("long").alias("boxes"))
    out = per.join(count, "cls").crossJoin(F.broadcast(n))
    return out.select(
        "cls", "tiles", "boxes",
        F.round(F.col("tiles") / F.col("__n"), 6).alias("share"),
        F.round("__views", 4).alias("expected_views"),
        F.round(F.col("boxes") / F.col("tiles"), 6).alias("boxes_per_tile"),
        F.ceil(F.round(F.col("__views") - F.col("tiles"), 6)).cast("long").alias("to_add"),
    )


def topup(deficits: DataFrame, tiles: str = "tiles", defects: str = "defects", target: str = "target", margin: float = 1.1) -> DataFrame:
    """``deficits`` with rate (tiles a defect), missing and more: defects to insert, with a margin; 0 if nothing is missing."""
    missing = F.greatest(F.lit(0), F.col(target) - F.col(tiles)).cast("long")
    rate = F.try_divide(F.col(tiles).cast("double"), F.col(defects))
    more = F.when(missing == 0, F.lit(0)).otherwise(F.ceil(F.round(F.lit(margin) * F.try_divide(missing.cast("double"), rate), 6)))
    return deficits.withColumn("rate", F.round(rate, 6)).withColumn("missing", missing).withColumn("more", more.cast("long"))
