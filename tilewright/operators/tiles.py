"""Tile grids: side, positions along an axis, enumeration, counts and grid variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalars import half_even

ROUNDINGS = ("floor", "half_even", "ceil")
BORDERS = ("inclusive", "exclusive", "flush", "pad")


def rounded(x: Column, how: Column | str) -> Column:
    how = F.lit(how) if isinstance(how, str) else how
    return F.when(how == "floor", F.floor(x)).when(how == "ceil", F.ceil(x)).otherwise(half_even(x)).cast("long")


def tile_side(height: Column, width: Column, fraction: float, rounding: Column | str = "half_even") -> Column:
    return F.greatest(F.lit(1), rounded(F.least(height, width) * F.lit(float(fraction)), rounding)).cast("long")


def stride_of(side: Column, overlap: float, rounding: Column | str = "half_even") -> Column:
    return F.greatest(F.lit(1), rounded(side * F.lit(1 - overlap), rounding)).cast("long")


def axis_positions(length: Column, side: Column, stride: Column, edge: str) -> Column:
    """Starts of the tiles along an axis: one at 0 if the axis is no longer than a tile; ``flush`` adds a last one at the end."""
    if edge not in ("drop", "flush"):
        raise ValueError(f"edge must be drop or flush, not {edge!r}")
    length = length.cast("long")
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(length - side, F.lit(0)), stride)
    if edge == "flush":
        steps = F.array_distinct(F.concat(steps, F.array(F.greatest(length - side, F.lit(0)))))
    return F.when(length <= side, F.array(F.lit(0).cast("long"))).otherwise(steps)


def with_grid(films: DataFrame, fraction: float, overlap: float, edge: str, height: str = "height", width: str = "width") -> DataFrame:
    """``films`` with side, xs and ys."""
    side = films.withColumn("side", tile_side(F.col(height), F.col(width), fraction))
    stride = stride_of(F.col("side"), overlap)
    return side.withColumn("xs", axis_positions(F.col(width), F.col("side"), stride, edge)).withColumn("ys", axis_positions(F.col(height), F.col("side"), stride, edge))


def enumerate_tiles(films: DataFrame, fraction: float, overlap: float, edge: str, **dims: str) -> DataFrame:
    """One row a tile, y outer and x inner. Narrow: it explodes each film where it is."""
    grid = with_grid(films, fraction, overlap, edge, **dims)
    return grid.withColumn("y", F.explode("ys")).withColumn("x", F.explode("xs")).drop("xs", "ys")


def tile_counts(films: DataFrame, fraction: float, overlap: float, edge: str, **dims: str) -> DataFrame:
    """``films`` with n_tiles, without enumerating the tiles."""
    grid = with_grid(films, fraction, overlap, edge, **dims)
    return grid.withColumn("n_tiles", (F.size("xs") * F.size("ys")).cast("long")).drop("xs", "ys")


def _axis_count(length: Column, side: Column, stride: Column, border: Column) -> Column:
    """Tiles along an axis under a border rule, in closed form."""
    over = length - side
    whole = F.floor(over / stride) + 1
    flush = whole + (F.pmod(over, stride) > 0).cast("long")
    exclusive = F.greatest(F.ceil(over / stride), F.lit(1))
    pad = F.ceil(length / stride)
    n = F.when(border == "inclusive", whole).when(border == "exclusive", exclusive).when(border == "flush", flush).otherwise(pad)
    return F.when(length <= side, F.lit(1)).otherwise(n).cast("long")


def grid_variants(films: DataFrame, fraction: float, overlap: float, height: str = "height", width: str = "width") -> DataFrame:
    """Tiles in total under each side rounding x stride rounding x border rule: the rules are exploded within each film's row, so
    one partial aggregate and 36 rows are all that moves."""
    rules = F.array(*(F.struct(F.lit(a).alias("side_rule"), F.lit(b).alias("stride_rule"), F.lit(c).alias("border")) for a in ROUNDINGS for b in ROUNDINGS for c in BORDERS))
    rows = films.select(F.col(height).cast("long").alias("h"), F.col(width).cast("long").alias("w"), F.explode(rules).alias("r")).select("h", "w", "r.*")
    rows = rows.withColumn("side", tile_side(F.col("h"), F.col("w"), fraction, F.col("side_rule")))
    rows = rows.withColumn("stride", stride_of(F.col("side"), overlap, F.col("stride_rule")))
    n = _axis_count(F.col("w"), F.col("side"), F.col("stride"), F.col("border")) * _axis_count(F.col("h"), F.col("side"), F.col("stride"), F.col("border"))
    return rows.groupBy("side_rule", "stride_rule", "border").agg(F.sum(n).cast("long").alias("n_tiles"))


def prune_variants(variants: DataFrame, low: int, high: int, cap: int = 6) -> DataFrame:
    """Variants with a total inside [low, high], the first ``cap`` in name order (a report's shortlist)."""
    return variants.where(F.col("n_tiles").between(low, high)).orderBy("side_rule", "stride_rule", "border").limit(cap)
