"""Label texts and names as expressions: byte-unique variants, hosts of film ids, epochs of checkpoint names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_variants(text: Column, most: int = 5) -> Column:
    """array<struct<added, text>>: a label text and those that mean the same, with 1 to ``most`` - 1 zeros appended to each number
    after the class. A text without rows has one variant, a line feed."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")

    def longer(k):
        def line(s):
            fields = F.split(F.trim(s), r"\s+")
            return F.concat_ws(" ", F.slice(fields, 1, 1), F.transform(F.slice(fields, 2, 1 << 20), lambda v: F.concat(v, F.lit("0" * k))))

        return F.concat(F.array_join(F.transform(lines, line), "\n"), F.lit("\n"))

    numbered = F.array(F.struct(F.lit(0).alias("added"), text.alias("text")), *(F.struct(F.lit(k).alias("added"), longer(k).alias("text")) for k in range(1, most)))
    return F.when(F.size(lines) == 0, F.array(F.struct(F.lit(0).alias("added"), F.lit("\n").alias("text")))).otherwise(numbered)


def unique_labels(labels: DataFrame, taken: DataFrame, key: str = "tile", text: str = "label_text", digest: str = "digest") -> DataFrame:
    """(key, added, text) of each label: its first variant whose SHA-256 is not in ``taken`` (digest); nulls where all are taken."""
    rows = labels.select(key, F.explode(label_variants(F.col(text))).alias("v")).select(key, "v.added", "v.text", F.sha2("v.text", 256).alias(digest))
    free = rows.join(taken.select(digest), digest, "left_anti").groupBy(key).agg(F.min(F.struct("added", "text")).alias("v"))
    return labels.select(key).join(free, key, "left").select(key, F.col("v.added").alias("added"), F.col("v.text").alias("text"))


def host_of(film: Column) -> Column:
    """The host in an implanted film's id: what follows the second ``-``; null without one."""
    return F.nullif(F.regexp_extract(film, "^[^-]*-[^-]*-(.*)$", 1), F.lit(""))


def epoch_of(name: Column) -> Column:
    """The number after ``epoch=`` in a checkpoint's name, -1 without one."""
    return F.coalesce(F.regexp_extract(name, "epoch=([0-9]+)", 1).try_cast("int"), F.lit(-1))


def latest_checkpoint(names: DataFrame, by: str, name: str, pattern: str = "") -> DataFrame:
    """(by, name, epoch): of the names that contain ``pattern`` the one of the highest epoch, the least name on ties."""
    rows = names.where(F.contains(F.col(name), F.lit(pattern))).groupBy(by).agg(F.min(F.struct((-epoch_of(F.col(name))).alias("e"), F.col(name).alias("n"))).alias("b"))
    return rows.select(by, F.col("b.n").alias(name), (-F.col("b.e")).alias("epoch"))
