"""Scalar expressions: ids, rounding, reproducible draws, label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class ids of the six target classes, by English label.
CLASS_OF_LABEL = {
    "porosity": 0,
    "inclusion": 1,
    "crack": 2,
    "undercut": 3,
    "lack of fusion": 4,
    "lack of penetration": 5,
}
#: The nine-class raster keeps 0 for background, classes 1 to 6 for the targets, 7 and 8 for two groups.
GROUP_VALUES = {"other_defect": 7, "excess_material": 8}


def exposure_of(stem: Column | str) -> Column:
    """A stem without one leading ``A_`` or ``B_``."""
    return F.regexp_replace(stem, "^[AB]_", "")


def tile_id(stem: Column, x: Column, y: Column, side: Column) -> Column:
    return F.concat(stem, F.lit("__x"), x.cast("string"), F.lit("__y"), y.cast("string"), F.lit("__s"), side.cast("string"))


def parse_tile_id(tile: Column) -> Column:
    """struct<stem, exposure, x, y, side> of a composed tile id; the numbers are null where it does not parse."""
    number = lambda k: F.regexp_extract(tile, r"__x(\d+)__y(\d+)__s(\d+)$", k).try_cast("long")
    stem = F.substring_index(tile, "__", 1)
    return F.struct(stem.alias("stem"), exposure_of(stem).alias("exposure"), number(1).alias("x"), number(2).alias("y"), number(3).alias("side"))


def half_even(x: Column) -> Column:
    """Banker's rounding to a whole number, as a long."""
    return F.rint(x.cast("double")).cast("long")


def draw_key(seed: int, *cols: Column) -> Column:
    """64 hex digits that order rows at random, the same in any layout: sha256 of ``seed|col|...``."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in cols)), 256)


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the draw key."""
    return F.conv(F.substring(draw_key(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stochastic_round(r: Column, u: Column) -> Column:
    """floor(r), plus one where the draw is under the fraction."""
    return (F.floor(r) + (u < r - F.floor(r)).cast("long")).cast("long")


def class_of(label: Column) -> Column:
    """Class id of a trimmed label, null if it is no target."""
    table = F.create_map(*(F.lit(x) for kv in CLASS_OF_LABEL.items() for x in kv))
    return F.try_element_at(table, F.trim(label))


def raster_value(label: Column) -> Column:
    """Value of a label in the nine-class raster, null if it has none."""
    groups = F.create_map(*(F.lit(x) for kv in GROUP_VALUES.items() for x in kv))
    return F.coalesce(class_of(label) + 1, F.try_element_at(groups, F.trim(label)))


def class_signature(classes: Column) -> Column:
    """``null`` for no class, else the sorted distinct classes joined by ``+``."""
    joined = F.array_join(F.transform(F.array_sort(F.array_distinct(classes)), lambda c: c.cast("string")), "+")
    return F.when(joined == "", "null").otherwise(joined)
