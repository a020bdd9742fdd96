"""Inventory and audit: pairing, orphans, duplicates, histograms, summaries, label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_path(image: Column, image_root: str, label_root: str) -> Column:
    """The label file of an image: the same path below the other root, with the suffix .json."""
    below = F.substring(image, len(image_root.rstrip("/")) + 1, 1 << 20)
    return F.concat(F.lit(label_root.rstrip("/")), F.regexp_replace(below, r"\.[^./]*$", ".json"))


def pair(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``images`` with has_label, by ``key``."""
    return images.join(labels.select(key).distinct().withColumn("__l", F.lit(True)), key, "left").withColumn("has_label", F.coalesce("__l", F.lit(False))).drop("__l")


def orphans(labels: DataFrame, images: DataFrame, key: str) -> DataFrame:
    return labels.join(images, key, "left_anti")


def pair_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n): keys on both sides, and on one only."""
    a, b = (d.select(key).where(F.col(key).isNotNull()).distinct().withColumn(c, F.lit(1)) for d, c in ((left, "__a"), (right, "__b")))
    side = F.when(F.col("__a").isNull(), "right_only").when(F.col("__b").isNull(), "left_only").otherwise("both")
    return a.join(b, key, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, content: Column, key: str) -> DataFrame:
    """(digest, n, first) of contents that occur more than once. Counts and the first key only: a group is never gathered."""
    rows = df.groupBy(F.sha1(content).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return rows.where("n > 1")


def redundant_count(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_redundant"))


def not_redundant(df: DataFrame, content: Column, key: str) -> DataFrame:
    """Rows that are the first of their content."""
    rows = df.withColumn("__d", F.sha1(content))
    later = rows.groupBy("__d").agg(F.count("*").alias("__n"), F.min(key).alias("__first")).where("__n > 1").drop("__n")
    return rows.join(later, "__d", "left").where(F.col("__first").isNull() | (F.col(key) == F.col("__first"))).drop("__d", "__first")


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def merged_counts(df: DataFrame, counts: str) -> DataFrame:
    """(key, n): the sum of map<string, long> columns over rows."""
    return df.select(F.explode(counts).alias("key", "value")).groupBy("key").agg(F.sum("value").cast("long").alias("n"))


def vector_sum(df: DataFrame, values: str) -> DataFrame:
    """(slot, total) of equally long arrays."""
    return df.select(F.posexplode(values).alias("slot", "v")).groupBy("slot").agg(F.sum("v").alias("total"))


def guarded_mean(total: Column, count: Column) -> Column:
    return total / F.greatest(count, F.lit(1))


def extent_summary(df: DataFrame, height: str = "height", width: str = "width") -> DataFrame:
    """Smallest, median and largest height and width, and how many are portrait."""
    out = []
    for c in (height, width):
        out += [F.min(c).cast("double").alias(f"{c}_min"), F.median(c).alias(f"{c}_median"), F.max(c).cast("double").alias(f"{c}_max")]
    return df.agg(*out, F.count_if(F.col(height) > F.col(width)).alias("portrait"))


def pixel_moments(df: DataFrame, value: Column) -> DataFrame:
    """Mean and population standard deviation over all rows."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def label_problems(cls: Column, cx: Column, cy: Column, w: Column, h: Column, n_classes: int) -> Column:
    """array<string>: what is wrong with a label line; empty if nothing is."""
    outside = ~(cx.between(0, 1) & cy.between(0, 1) & w.between(0, 1) & h.between(0, 1))
    edge = (cx - w / 2 < -1e-6) | (cy - h / 2 < -1e-6) | (cx + w / 2 > 1 + 1e-6) | (cy + h / 2 > 1 + 1e-6)
    return F.array_compact(F.array(F.when(~cls.between(0, n_classes - 1), "class"), F.when(outside, "range"), F.when(edge & ~outside, "edge"), F.when((w <= 0) | (h <= 0), "empty")))


def film_flags(crop_share: Column, extended: Column) -> Column:
    """array<string> of whole_film (over 0.95), sliver (under 0.05) and extended."""
    return F.array_compact(F.array(F.when(crop_share > 0.95, "whole_film"), F.when(crop_share < 0.05, "sliver"), F.when(extended, "extended")))


def listed(df: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose key is in ``include`` (if given) and not in ``exclude`` (if given)."""
    if include is not None:
        df = df.join(include.select(key), key, "left_semi")
    return df if exclude is None else df.join(exclude.select(key), key, "left_anti")


def catalogue_filter(df: DataFrame, customers: list[str], use_case: str, keep_clean: list[str]) -> DataFrame:
    """Catalogue rows of the customers with annotations in a use case, or on the keep list."""
    annotated = F.exists("use_cases", lambda u: (u["use_case"] == use_case) & (F.size(u["annotations"]) > 0))
    return df.where((F.col("customer_id").isin(customers) & F.coalesce(annotated, F.lit(False))) | F.col("_id").isin(keep_clean))


def with_fallback(df: DataFrame, *sources: str) -> DataFrame:
    """``df`` with seam and seam_source: the first non-null of the columns ``sources``, and its name."""
    tag = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in sources))
    return df.withColumn("seam", F.coalesce(*sources)).withColumn("seam_source", tag)


def tile_bands(tiles: DataFrame, part: str = "part") -> DataFrame:
    """Of each part's checked tiles (side, std, saturated, n_boxes): how many there are, are under 160 or over 640 pixels, flat, over 30 %
    saturated, with boxes; boxes in all and the most of one tile."""
    return tiles.groupBy(part).agg(
        F.count("*").alias("tiles"), F.count_if(F.col("side") < 160).alias("small"), F.count_if(F.col("side") > 640).alias("large"), F.count_if(F.col("std") < 2).alias("flat"),
        F.count_if(F.col("saturated") > 0.30).alias("saturated"), F.count_if(F.col("n_boxes") > 0).alias("positive"), F.sum("n_boxes").alias("boxes"), F.max("n_boxes").alias("most_boxes"),
    )


def cut_shares(boxes: DataFrame, cls: str, cut: str) -> DataFrame:
    """Of each class the boxes, those that a tile's edge cuts, and their share."""
    out = boxes.groupBy(cls).agg(F.count("*").alias("boxes"), F.count_if(F.col(cut)).alias("cut"))
    return out.withColumn("share", F.round(F.col("cut") / F.col("boxes"), 6))
