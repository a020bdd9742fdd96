"""Geometry on arrays of struct<x, y> as expressions. Everything stays in generated JVM code or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.arrays import let

def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


def bbox(points: Column) -> Column:
    """struct<x0, y0, x1, y1>; null without points."""
    box = F.struct(F.array_min(xs(points)).alias("x0"), F.array_min(ys(points)).alias("y0"), F.array_max(xs(points)).alias("x1"), F.array_max(ys(points)).alias("y1"))
    return F.when(F.size(points) > 0, box)


def polygon_area(points: Column) -> Column:
    """Shoelace area; with fewer than three points the area of the bounding box."""
    n = F.size(points)
    after = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    box = bbox(points)
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]))


def rectangle_corners(points: Column) -> Column:
    """Two opposite corners -> four; other polygons as they are."""
    a, b = points[0], points[1]
    corner = lambda p, q: F.struct(p["x"].alias("x"), q["y"].alias("y"))
    return F.when(F.size(points) == 2, F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b))).otherwise(points)


def rotate_quarter(points: Column, width: Column | float, height: Column | float, k: int) -> Column:
    """Quarter turns counter-clockwise of an image ``width`` x ``height``: (x, y) -> (y, width - 1 - x), k times."""
    width, height = (x if isinstance(x, Column) else F.lit(float(x)) for x in (width, height))
    for _ in range(k % 4):
        side = width
        points = _turn(points, side)
        width, height = height, width
    return points


def _turn(points: Column, side: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["y"].alias("x"), (side - 1 - p["x"]).alias("y")))


def flip(points: Column, width: Column, height: Column, left_right: bool, top_bottom: bool) -> Column:
    return F.transform(points, lambda p: F.struct((width - 1 - p["x"] if left_right else p["x"]).alias("x"), (height - 1 - p["y"] if top_bottom else p["y"]).alias("y")))


def clip_box(box: Column, x: Column, y: Column, side: Column) -> Column:
    """The whole pixels of a box inside a window, as struct<x0, y0, x1, y1> in the window; null if the float clip is empty."""
    x0, y0 = F.greatest(box["x0"] - x, F.lit(0.0)), F.greatest(box["y0"] - y, F.lit(0.0))
    x1, y1 = F.least(box["x1"] - x, side.cast("double")), F.least(box["y1"] - y, side.cast("double"))
    inner = F.struct(F.floor(x0).alias("x0"), F.floor(y0).alias("y0"), F.ceil(x1).alias("x1"), F.ceil(y1).alias("y1"))
    return F.when((x1 - x0 > 0) & (y1 - y0 > 0), inner)


def overlaps(box: Column, x: Column, y: Column, side: Column) -> Column:
    """Inclusive test of a box against a window."""
    return (box["x1"] >= x) & (box["x0"] <= x + side) & (box["y1"] >= y) & (box["y0"] <= y + side)


def in_window(px: Column, py: Column, x: Column, y: Column, side: Column) -> Column:
    """Half-open test of a point against a window."""
    return (px >= x) & (px < x + side) & (py >= y) & (py < y + side)


def point_in_polygon(px: Column, py: Column, points: Column) -> Column:
    """1 inside, 0 on the boundary, -1 outside."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    edges = F.zip_with(points, after, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    def on(e):
        cross = (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
        return (cross == 0) & px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    def crosses(e):
        spans = (e["ay"] > py) != (e["by"] > py)
        at = e["ax"] + F.try_divide((py - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"])
        return F.when(spans & (px < at), 1).otherwise(0)

    count = F.aggregate(F.transform(edges, crosses), F.lit(0), lambda s, v: s + v)
    return F.when(F.exists(edges, on), 0).when(count % 2 == 1, 1).otherwise(-1)


def keep_rule(w: Column, h: Column, visible: Column, side: Column, min_side: float = 4, visible_share: float = 0.10, tile_share: float = 0.005) -> Column:
    """Both sides long enough, and enough of the polygon visible or enough of the tile covered."""
    return (w >= min_side) & (h >= min_side) & ((visible >= visible_share) | (w * h >= F.lit(tile_share) * side * side))


def yolo_box(cls: Column, box: Column, side: Column) -> Column:
    """``class cx cy w h`` with six decimals, relative to the tile."""
    s = side.cast("double")
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, (box["x0"] + box["x1"]) / 2 / s, (box["y0"] + box["y1"]) / 2 / s, (box["x1"] - box["x0"]) / s, (box["y1"] - box["y0"]) / s)


def yolo_segment(cls: Column, points: Column, side: Column) -> Column:
    """``class x y x y ...`` with six decimals, relative to the tile and clipped to it."""
    s = side.cast("double")
    unit = lambda v: F.format_string("%.6f", F.least(F.greatest(v / s, F.lit(0.0)), F.lit(1.0)))
    return F.concat_ws(" ", cls.cast("string"), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", unit(p["x"]), unit(p["y"]))), " "))


def shape_key(points: Column, digits: int = 2) -> Column:
    """A key that a translation leaves as it is: rounded differences from the first point."""
    zero = lambda v: F.round(v, digits) + F.lit(0.0)  # noqa: E731  no negative zeros
    return F.to_json(let(points, lambda q: F.transform(q, lambda p: F.array(zero(p["x"] - q[0]["x"]), zero(p["y"] - q[0]["y"])))))


def crop_rect(seam: Column, label: Column, height: Column, width: Column, margin: float) -> Column:
    """struct<x0, y0, x1, y1, flag>: the seam's box padded by half-even(margin * its shorter side) and clipped, grown to hold the
    padded label box. flag: contained, extended, or no_seam (then without a box)."""
    pad = F.rint(F.lit(margin) * F.least(seam["x1"] - seam["x0"], seam["y1"] - seam["y0"]))

    def padded(b):
        return (F.greatest(b["x0"] - pad, F.lit(0)), F.greatest(b["y0"] - pad, F.lit(0)), F.least(b["x1"] + pad, width), F.least(b["y1"] + pad, height))

    s, t = padded(seam), padded(label)
    grown = (F.least(s[0], t[0]), F.least(s[1], t[1]), F.greatest(s[2], t[2]), F.greatest(s[3], t[3]))
    same = (grown[0] == s[0]) & (grown[1] == s[1]) & (grown[2] == s[2]) & (grown[3] == s[3])
    has = label.isNotNull()
    out = [F.when(has, g).otherwise(x).cast("long").alias(n) for g, x, n in zip(grown, s, ("x0", "y0", "x1", "y1"))]
    rect = F.struct(*out, F.when(has & ~same, "extended").otherwise("contained").alias("flag"))
    none = F.struct(*(F.lit(None).cast("long").alias(n) for n in ("x0", "y0", "x1", "y1")), F.lit("no_seam").alias("flag"))
    return F.when(seam.isNull(), none).otherwise(rect)
