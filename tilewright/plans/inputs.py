"""The tables that the catalogue's queries run on, seen as films, tiles, boxes and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRACTION, OVERLAP = 0.5, 0.5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def films(spark: SparkSession, sf: str) -> DataFrame:
    """film, height, width: a part is a film."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("film"), (100 + F.col("p_size") * 11).cast("long").alias("height"), (100 + F.col("p_partkey") % 97 * 13).cast("long").alias("width"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """film, shape, cls, x0, y0, x1, y1: a line item is a box on its part's film."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    x0, y0 = (F.col("l_orderkey") % 480).cast("double"), (F.col("l_suppkey") * 37 % 400).cast("double")
    return l.select(
        F.col("l_partkey").alias("film"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("long")).alias("shape"),
        F.concat("l_returnflag", "l_linestatus").alias("cls"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 5 + F.col("l_quantity")).alias("x1"), (y0 + 5 + F.col("l_linenumber") * 9).alias("y1"),
    )


#: The same as SQL.
FILMS = "SELECT p_partkey AS film, (100 + p_size * 11)::BIGINT AS height, (100 + p_partkey % 97 * 13)::BIGINT AS width FROM part"
BOXES = """SELECT l_partkey AS film, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_quantity::BIGINT) AS shape, l_returnflag || l_linestatus AS cls,
  (l_orderkey % 480)::DOUBLE AS x0, (l_suppkey * 37 % 400)::DOUBLE AS y0, (l_orderkey % 480 + 5 + l_quantity)::DOUBLE AS x1, (l_suppkey * 37 % 400 + 5 + l_linenumber * 9)::DOUBLE AS y1 FROM lineitem"""
GRID = f"""SELECT *, greatest(1, round_even(side * {1 - OVERLAP}, 0)::BIGINT) AS stride FROM
  (SELECT *, greatest(1, round_even(least(height, width) * {FRACTION}, 0)::BIGINT) AS side FROM ({FILMS}))"""


def axis(length: str, edge: str) -> str:
    """SQL list of positions along an axis of the grid."""
    steps = f"range(0, {length} - side + 1, stride)"
    if edge == "flush":
        steps = f"list_distinct(list_append({steps}, {length} - side))"
    return f"CASE WHEN {length} <= side THEN [0::BIGINT] ELSE {steps} END"


def tiles_sql(edge: str) -> str:
    return f"SELECT film, side, x, unnest(ys) AS y FROM (SELECT film, side, unnest({axis('width', edge)}) AS x, {axis('height', edge)} AS ys FROM ({GRID}))"
