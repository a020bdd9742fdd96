"""Film-level work in Arrow batches: tiles with exact polygon boxes, rendering, bead geometry, contrasts.

A film is one task's unit: its pixels are decoded once, and its tiles come from ``tiles.enumerate_tiles`` grouped by film. Films are
bounded by what one image file holds, so a group fits a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tilewright.functions import raster
from tilewright.sources import formats


def tile_boxes(pairs: DataFrame, min_side: float = 4, visible: float = 0.10, tile: float = 0.005) -> DataFrame:
    """Exact boxes of polygon-window pairs (tile, class_id, ordinal, points, x, y, side): rows the keep rule accepts, with the
    visible share. Row by row, so nothing is shuffled; pairs come from a join that has dropped windows out of reach."""

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                kept = raster.kept_box(np.array([(p["x"], p["y"]) for p in r.points]), r.x, r.y, r.side, min_side, visible, tile)
                if kept:
                    (x0, y0, x1, y1), share = kept
                    out.append((r.tile, r.class_id, r.ordinal, x0, y0, x1, y1, share))
            yield pd.DataFrame(out, columns=["tile", "class_id", "ordinal", "x0", "y0", "x1", "y1", "visible"])

    return pairs.select("tile", "class_id", "ordinal", "points", "x", "y", "side").mapInPandas(run, "tile string, class_id int, ordinal int, x0 int, y0 int, x1 int, y1 int, visible double")


def render(films: DataFrame, **options) -> DataFrame:
    """(tile, part, label_text, png) of films (content, tiles array<struct<tile, part, x, y, side, label_text>>): each film is
    decoded once for all its tiles."""

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                film = formats.read_tiff(r.content)
                rows = [(t["tile"], t["part"], t["label_text"], formats.write_png(raster.preprocess(film, t["x"], t["y"], t["side"], **options))) for t in r.tiles]
                yield pd.DataFrame(rows, columns=["tile", "part", "label_text", "png"])

    return films.select("content", "tiles").mapInPandas(run, "tile string, part string, label_text string, png binary")


def beads(profiles: DataFrame) -> DataFrame:
    """(stem, centre, half_width, top, bottom) of row profiles (stem, profile); nulls where no bead is found."""

    def run(frames):
        for f in frames:
            rows = []
            for stem, profile in zip(f["stem"], f["profile"]):
                b = raster.bead(np.asarray(profile, float)) or {}
                rows.append((stem, b.get("centre"), b.get("half_width"), b.get("top"), b.get("bottom")))
            out = pd.DataFrame(rows, columns=["stem", "centre", "half_width", "top", "bottom"])
            yield out.astype({"centre": "float64", "half_width": "float64", "top": "Int64", "bottom": "Int64"})

    return profiles.select("stem", "profile").mapInPandas(run, "stem string, centre double, half_width double, top long, bottom long")


def instance_contrasts(films: DataFrame, least: int = 4, ring: int = 5) -> DataFrame:
    """(stem, instance, contrast) of mask components: mean inside less the mean of a ring around; small ones are passed over.
    ``films``: stem, height, width, pixels and mask as flat arrays."""

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                image = np.asarray(r.pixels, float).reshape(r.height, r.width)
                mask = np.asarray(r.mask, bool).reshape(r.height, r.width)
                labels, n = raster.components(mask)
                for k in range(1, n + 1):
                    own = labels == k
                    if own.sum() < least:
                        continue
                    wide = own.copy()
                    for _ in range(ring):
                        p = np.pad(wide, 1)
                        wide = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
                    around = wide & ~mask
                    if around.any():
                        rows.append((r.stem, k, float(image[own].mean() - image[around].mean())))
            yield pd.DataFrame(rows, columns=["stem", "instance", "contrast"]).astype({"instance": "int64", "contrast": "float64"})

    return films.select("stem", "height", "width", "pixels", "mask").mapInPandas(run, "stem string, instance long, contrast double")


def _image(r, name: str = "pixels") -> np.ndarray:
    return np.asarray(getattr(r, name), float).reshape(r.height, r.width)


def _points(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


def _by_row(df: DataFrame, columns: list[str], row, schema: str) -> DataFrame:
    """``row`` of each row of ``df``: a tuple or None, in Arrow batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            out = [x for x in map(row, f.itertuples(index=False)) if x is not None]
            yield pd.DataFrame({n: pd.Series([x[i] for x in out], dtype=object) for i, n in enumerate(names)})

    return df.select(*columns).mapInPandas(run, schema)


def local_contrasts(shapes: DataFrame, **options) -> DataFrame:
    """(film, shape, cnr) of shapes (film, shape, points, height, width, pixels around them); null without a ring. Films of one size with
    equal polygons are worked on together, a quarter of a million pixels at once."""

    def run(frames):
        for f in frames:
            cnr, alike = np.full(len(f), np.nan), {}
            for i, (points, height, width) in enumerate(zip(f["points"], f["height"], f["width"])):
                alike.setdefault((height, width, _points(points).tobytes()), []).append(i)
            pixels = f["pixels"].to_numpy()
            for (height, width, points), rows in alike.items():
                step = max(1, 2**18 // max(1, height * width))
                for at in (rows[i : i + step] for i in range(0, len(rows), step)):
                    images = np.array([np.asarray(pixels[i], float) for i in at]).reshape(len(at), height, width)
                    cnr[at] = raster.local_cnrs(images, np.frombuffer(points).reshape(-1, 2), **options)
            yield pd.DataFrame({"film": f["film"], "shape": f["shape"], "cnr": pd.Series(cnr, index=f.index).astype("Float64")})

    return shapes.select("film", "shape", "points", "height", "width", "pixels").mapInPandas(run, "film string, shape string, cnr double")


def pore_dips(shapes: DataFrame, **options) -> DataFrame:
    """(film, shape, background, dip) of pores (as for ``local_contrasts``, with others: the film's other shapes as a flat mask, or null);
    pores without a measurable dip have no row."""

    def row(r):
        others = None if r.others is None else np.asarray(r.others, bool).reshape(r.height, r.width)
        found = raster.pore_dip(_image(r), _points(r.points), others, **options)
        return (r.film, r.shape, *found) if found else None

    return _by_row(shapes, ["film", "shape", "points", "height", "width", "pixels", "others"], row, "film string, shape string, background double, dip double")


def keep_out_areas(films: DataFrame, grow: int) -> DataFrame:
    """(film, blocked, free): pixels where nothing may be put, and the others. ``films``: film, height, width, shapes (array of
    polygons), windows array<struct<x, y, side>>."""

    def row(r):
        mask = raster.keep_out(r.height, r.width, [_points(p) for p in r.shapes], grow, [(w["x"], w["y"], w["side"]) for w in r.windows])
        return r.film, int(mask.sum()), int((~mask).sum())

    return _by_row(films, ["film", "height", "width", "shapes", "windows"], row, "film string, blocked long, free long")


def mask_clashes(pairs: DataFrame, grow: int) -> DataFrame:
    """(film, shape, other) of pairs with points and other_points whose masks come within ``grow`` pixels; pairs come from a box join."""

    def row(r):
        return (r.film, r.shape, r.other) if raster.masks_clash(_points(r.points), _points(r.other_points), grow) else None

    return _by_row(pairs, ["film", "shape", "other", "points", "other_points"], row, "film string, shape string, other string")


def compare_crops(crops: DataFrame) -> DataFrame:
    """(film, status) of crops (film, height, width, pixels; turns, x, y; crop_height, crop_width, crop): exact, the number of pixels that
    differ, or what is wrong with the place."""

    def row(r):
        own = np.asarray(r.crop, float).reshape(r.crop_height, r.crop_width)
        return r.film, raster.compare_cut(_image(r), r.turns, r.x, r.y, own)

    return _by_row(crops, ["film", "height", "width", "pixels", "turns", "x", "y", "crop_height", "crop_width", "crop"], row, "film string, status string")


def rederivation(pairs: DataFrame, warn: float = 0.8, **options) -> DataFrame:
    """(tile, instances, multi_piece, vertices, low_iou, deviation) of polygon-window pairs (tile, points, x, y, side) that the keep
    rule accepts: how well their traced polygons give the masks back."""
    from pyspark.sql import functions as F

    def row(r):
        found = raster.rederived(_points(r.points), r.x, r.y, r.side, **options)
        return (r.tile, found["pieces"], found["vertices"], found["iou"], found["deviation"]) if found else None

    each = _by_row(pairs, ["tile", "points", "x", "y", "side"], row, "tile string, pieces int, vertices int, iou double, deviation double")
    return each.groupBy("tile").agg(F.count("*").alias("instances"), F.count_if(F.col("pieces") > 1).alias("multi_piece"), F.sum("vertices").alias("vertices"), F.count_if(F.col("iou") < warn).alias("low_iou"), F.max("deviation").alias("deviation"))


def polygon_pixels(shapes: DataFrame) -> DataFrame:
    """(id, filled, visible): pixels of a polygon on a canvas height x width, and of it in the window (x, y, side)."""

    def row(r):
        seen = raster.visible_mask(_points(r.points), r.x, r.y, r.side)
        return r.id, int(raster.fill_polygon(_points(r.points), r.height, r.width).sum()), 0 if seen is None else int(seen.sum())

    return _by_row(shapes, ["id", "points", "height", "width", "x", "y", "side"], row, "id long, filled long, visible long")


def raster_round_trip(shapes: DataFrame, eps: float) -> DataFrame:
    """(id, value, vertices, area, pixels) of shapes (id, height, width, polygons array<struct<points, value>>) drawn into one class raster
    and traced out of it again, the contours simplified by ``eps``."""

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                image = raster.class_raster([(_points(p["points"]), p["value"]) for p in r.polygons], r.height, r.width)
                for value, line in raster.raster_shapes(image):
                    simple = raster.simplify(line, eps)
                    out.append((r.id, value, len(simple), raster.area(simple), int((image == value).sum())))
            yield pd.DataFrame(out, columns=["id", "value", "vertices", "area", "pixels"])

    return shapes.select("id", "height", "width", "polygons").mapInPandas(run, "id long, value int, vertices int, area double, pixels long")


def array_kernel(rows: DataFrame, kernel, key: str = "id", value: str = "pixels") -> DataFrame:
    """(key, pixels) of ``kernel`` over each row's flat array: for the numpy kernels that work on one raster at a time."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "pixels": [np.asarray(kernel(np.asarray(v, float)), float).ravel() for v in f[value]]})

    return rows.select(key, value).mapInPandas(run, f"{rows.select(key).schema.simpleString()[7:-1].replace(':', ' ', 1)}, pixels array<double>")
