"""Incremental versions: label or tile files that arrive over time, and their running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Rows of JSON-line files as they are written to ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def running_counts(tiles: DataFrame, *by: str) -> DataFrame:
    """Tiles and positives of each group so far; the state is one row a group."""
    return tiles.groupBy(*by).agg(F.count("*").alias("n_tiles"), F.count_if("has_box").alias("positive"))


def first_seen(tiles: DataFrame, time: str, delay: str, *key: str) -> DataFrame:
    """Tiles that were not seen within ``delay``: a second run of the same files adds nothing."""
    return tiles.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def append(df: DataFrame, path: str, checkpoint: str):
    """Write what is new to ``path`` and stop when the input is read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
