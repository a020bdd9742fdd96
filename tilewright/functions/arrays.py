"""Kernels on small rasters kept as arrays, as expressions: stretch, profiles, correlation.

What an expression names inside a lambda is evaluated at each call, so values that a lambda needs are bound once by ``let``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _interpolated(ordered: Column, q: float) -> Column:
    at = (F.size(ordered) - 1) * F.lit(q / 100.0)
    lo = F.floor(at).cast("int")
    a, b = F.get(ordered, lo), F.get(ordered, F.least(lo + 1, F.size(ordered) - 1))
    return a + (b - a) * (at - lo)


def percentile_of(values: Column, q: float) -> Column:
    """Linearly interpolated percentile (q in 0..100) of an array without nulls."""
    return let(F.sort_array(values), lambda s: _interpolated(s, q))


def contrast_stretch(values: Column, low: float, high: float) -> Column:
    """array<int> 0..255: linear between the array's own percentiles, clipped and truncated; zeros if the range is empty."""

    def scaled(v):
        one = lambda x: F.least(F.greatest((x - v["lo"]) / (v["hi"] - v["lo"]) * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int")
        return F.when(v["hi"] > v["lo"], F.transform(v["v"], one)).otherwise(F.transform(v["v"], lambda _: F.lit(0)))

    def ranged(v):
        return let(F.sort_array(v), lambda s: let(F.struct(v.alias("v"), _interpolated(s, low).alias("lo"), _interpolated(s, high).alias("hi")), scaled))

    return let(values, ranged)


def mean_of(values: Column) -> Column:
    return let(values, lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def _spread(values: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of struct<v, mean, std> of an array; population deviation."""

    def with_std(m):
        std = F.sqrt(F.aggregate(m["v"], F.lit(0.0), lambda s, x: s + (x - m["mean"]) * (x - m["mean"])) / F.size(m["v"]))
        return let(F.struct(m["v"].alias("v"), m["mean"].alias("mean"), std.alias("std")), body)

    return let(values, lambda v: let(F.struct(v.alias("v"), mean_of(v).alias("mean")), with_std))


def z_scores(values: Column) -> Column:
    """Values less the mean over the population deviation; zeros where that is 0."""
    return _spread(values, lambda m: F.transform(m["v"], lambda x: F.when(m["std"] > 0, (x - m["mean"]) / m["std"]).otherwise(F.lit(0.0))))


def correlation(a: Column, b: Column) -> Column:
    """Normalised cross-correlation of two arrays of one length; 0 if one is constant."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))

    def centred(v):
        add = lambda s, p: F.struct((s["a"] + (p["x"] - v["x"]) * (p["x"] - v["x"])).alias("a"), (s["b"] + (p["y"] - v["y"]) * (p["y"] - v["y"])).alias("b"), (s["c"] + (p["x"] - v["x"]) * (p["y"] - v["y"])).alias("c"))
        return F.aggregate(v["p"], zero, add, lambda s: F.when((s["a"] > 0) & (s["b"] > 0), s["c"] / F.sqrt(s["a"] * s["b"])).otherwise(F.lit(0.0)))

    def means(p):
        total = F.aggregate(p, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, q: F.struct((s["x"] + q["x"]).alias("x"), (s["y"] + q["y"]).alias("y")))
        return let(total, lambda t: let(F.struct(p.alias("p"), (t["x"] / F.size(p)).alias("x"), (t["y"] / F.size(p)).alias("y")), centred))

    return let(pairs, means)


def worst_slice_score(profile: Column, target: Column, n: int, size: int) -> Column:
    """The smallest correlation over ``n`` consecutive slices of ``size`` values; minus infinity if a slice of the target is constant
    or one of the arrays is too short."""

    def whole(v):
        def one(i):
            a, b = F.slice(v["p"], i * size + 1, size), F.slice(v["t"], i * size + 1, size)
            flat = F.array_max(b) <= F.array_min(b)
            return F.when(flat, F.lit(float("-inf"))).otherwise(correlation(a, b))

        fits = F.least(F.size(v["p"]), F.size(v["t"])) >= n * size
        return F.when(fits, F.array_min(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one))).otherwise(F.lit(float("-inf")))

    return let(F.struct(profile.alias("p"), target.alias("t")), whole)


def source_profile(values: Column, centre: Column, half: int = 150) -> Column:
    """struct<values, off>: z-scores of the rows within ``half`` of the centre row, and the centre's place among them."""

    def cut(v):
        first, stop = F.greatest(v["c"] - half, F.lit(0)), F.least(v["c"] + half, F.size(v["v"]))
        return F.struct(z_scores(F.slice(v["v"], first + 1, stop - first)).alias("values"), (v["c"] - first).alias("off"))

    return let(F.struct(values.alias("v"), centre.cast("int").alias("c")), cut)


def _rows(values: Column, height: int, width: int, body: Callable[[Column], Column]) -> Column:
    """``body`` of each row of a flat raster."""
    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: body(F.slice(v, r * width + 1, F.lit(width)))))


def row_medians(values: Column, height: int, width: int) -> Column:
    """Median of each row of a flat raster."""
    return _rows(values, height, width, lambda r: percentile_of(r, 50))


def flip_rows(values: Column, height: int, width: int) -> Column:
    """Top to bottom."""
    return F.flatten(F.reverse(_rows(values, height, width, lambda r: r)))


def flip_columns(values: Column, height: int, width: int) -> Column:
    """Left to right."""
    return F.flatten(_rows(values, height, width, F.reverse))


def quarter_turn(values: Column, height: int, width: int) -> Column:
    """A flat raster turned counter-clockwise, then ``width`` x ``height``."""
    at = lambda i: F.pmod(i, F.lit(height)) * width + (width - 1 - F.floor(i / height))
    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: F.get(v, at(i).cast("int"))))


def crop(values: Column, width: int, x: Column, y: Column, side: int) -> Column:
    """The ``side`` x ``side`` window at (x, y) of a flat raster of ``width`` columns."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.slice(v, ((y + r) * width + x + 1).cast("int"), F.lit(side)))
    return F.flatten(let(values, cut))


def resize_nearest(values: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """A flat raster brought to another size without new values: each pixel takes the one at floor(place * old / new)."""
    at = lambda i: F.floor(F.floor(i / to_width) * height / to_height) * width + F.floor(F.pmod(i, F.lit(to_width)) * width / to_width)
    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(to_height * to_width - 1)), lambda i: F.get(v, at(i).cast("int"))))


def contrast_scale(host_grain: Column, source_grain: Column) -> Column:
    """By how much a residual is scaled on its host: the ratio of the grains, the source's being at least 1e-9."""
    return host_grain / F.greatest(source_grain, F.lit(1e-9))


def blend(background: Column, patch: Column, weight: Column) -> Column:
    """background * (1 - w) + patch * w."""
    both = F.zip_with(background, patch, lambda b, p: F.struct(b.alias("b"), p.alias("p")))
    return F.zip_with(both, weight, lambda v, w: v["b"] * (1 - w) + v["p"] * w)


def to_additive(values: Column, base: float) -> Column:
    """log(max(I - base, 1)): absorption adds up in this space."""
    return F.transform(values, lambda v: F.ln(F.greatest(v - F.lit(base), F.lit(1.0))))


def from_additive(values: Column, base: float, top: int = 65535) -> Column:
    """Back to whole grey values, clipped."""
    return F.transform(values, lambda v: F.least(F.greatest(F.rint(F.exp(v) + F.lit(base)), F.lit(0.0)), F.lit(float(top))).cast("int"))


def pixel_qa(values: Column) -> Column:
    """struct<mean, std, saturated>: population deviation and share of 0 and 255."""
    sat = lambda v: F.size(F.filter(v, lambda x: (x == 0) | (x == 255))) / F.size(v)
    return _spread(values, lambda m: F.struct(m["mean"].alias("mean"), m["std"].alias("std"), sat(m["v"]).alias("saturated")))


def region_contrast(values: Column, inside: Column) -> Column:
    """Mean inside less mean outside; null if either is empty."""
    pairs = F.zip_with(values, inside, lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i")))
    part = lambda keep: F.transform(F.filter(pairs, keep), lambda p: p["v"])
    a, b = part(lambda p: p["i"]), part(lambda p: ~p["i"])
    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: F.when((F.size(v["a"]) > 0) & (F.size(v["b"]) > 0), mean_of(v["a"]) - mean_of(v["b"])))


def mask_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boolean arrays; null if both are empty."""
    both = F.zip_with(a, b, lambda x, y: F.struct((x & y).cast("int").alias("i"), (x | y).cast("int").alias("u")))
    total = F.aggregate(both, F.struct(F.lit(0).alias("i"), F.lit(0).alias("u")), lambda s, v: F.struct((s["i"] + v["i"]).alias("i"), (s["u"] + v["u"]).alias("u")))
    return F.try_divide(total["i"], total["u"])
