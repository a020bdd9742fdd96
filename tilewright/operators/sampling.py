"""Seeded selection: samples, splits, greedy fills, stochastic copies. Draws are hashes of ids, so layout never matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.prefix import draw_rank, running_before
from tilewright.functions.scalars import draw_key, stochastic_round, uniform


def sample(df: DataFrame, n: Column, seed: int, *ids: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """The first ``n`` rows by draw, in each ``partition``; ``n`` may use columns of ``df``."""
    ranked = draw_rank(df.withColumn("__key", draw_key(seed, *map(F.col, ids))), "__key", "__rank", partition)
    return ranked.where(F.col("__rank") < n).drop("__key", "__rank")


def split_random(df: DataFrame, ratio: float, seed: int, *ids: str) -> DataFrame:
    """``df`` with part: the first half-even(n * ratio) rows by draw are val."""
    ranked = draw_rank(df.withColumn("__key", draw_key(seed, *map(F.col, ids))), "__key", "__rank")
    n = df.agg(F.rint(F.count("*") * F.lit(ratio)).cast("long").alias("__n"))
    return ranked.crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col("__rank") < F.col("__n"), "val").otherwise("train")).drop("__key", "__rank", "__n")  # one row


def split_grouped(df: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    """(group, n, part): groups in random order go to val while the rows of the groups before are under n * ratio."""
    sizes = df.groupBy(group).agg(F.count("*").cast("long").alias("n")).withColumn("__key", draw_key(seed, F.col(group)))
    filled = running_before(sizes, "__key", F.col("n"), "__before")
    target = df.agg((F.count("*") * F.lit(ratio)).alias("__target"))
    part = F.when(F.col("__before") < F.col("__target"), "val").otherwise("train")
    return filled.crossJoin(F.broadcast(target)).select(group, "n", part.alias("part"))  # one row is broadcast


def select_pos_neg(df: DataFrame, positive: Column, clean: Column, ratio: float, seed: int, *ids: str) -> DataFrame:
    """All positives and, by draw, half-even(positives * ratio) clean rows; rows that are neither stay out."""
    pos, neg = df.where(positive), df.where(clean)
    n = pos.agg(F.rint(F.count("*") * F.lit(ratio)).cast("long").alias("__n"))
    chosen = sample(neg.crossJoin(F.broadcast(n)), F.col("__n"), seed, *ids).drop("__n")
    return pos.withColumn("kind", F.lit("positive")).unionByName(chosen.withColumn("kind", F.lit("clean")))


def with_copies(df: DataFrame, factor: Column, seed: int, *ids: str) -> DataFrame:
    """``df`` with copies: the factor rounded up or down by one draw a row."""
    return df.withColumn("copies", stochastic_round(factor, uniform(seed, *map(F.col, ids))))


def replicate(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row ``copies`` times; rows with none go."""
    return df.where(F.col(copies) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))


def trim_arms(df: DataFrame, arm: str, bucket: str, seed: int, *ids: str) -> DataFrame:
    """``df`` with keep: every arm keeps, of each bucket, as many rows by draw as the smallest arm has.

    A bucket that an arm lacks is trimmed to nothing in the others.
    """
    counts = df.groupBy(bucket, arm).agg(F.count("*").alias("__n"))
    arms = df.select(arm).distinct().agg(F.count("*").alias("__arms"))
    least = counts.groupBy(bucket).agg(F.min("__n").alias("__least"), F.count("*").alias("__have")).crossJoin(F.broadcast(arms))
    least = least.select(bucket, F.when(F.col("__have") == F.col("__arms"), F.col("__least")).otherwise(0).alias("__least"))
    ranked = draw_rank(df.withColumn("__key", draw_key(seed, *map(F.col, ids))), "__key", "__rank", (arm, bucket))
    return ranked.join(least, bucket).withColumn("keep", F.col("__rank") < F.col("__least")).drop("__key", "__rank", "__least")


def trim_report(trimmed: DataFrame, arm: str, bucket: str) -> DataFrame:
    """(arm, bucket, before, after, dropped) of rows with keep, and a row for each arm's total (bucket null)."""
    counts = (F.count("*").alias("before"), F.count_if("keep").alias("after"), F.count_if(~F.col("keep")).alias("dropped"))
    return trimmed.groupingSets([[F.col(arm), F.col(bucket)], [F.col(arm)]], arm, bucket).agg(*counts)
