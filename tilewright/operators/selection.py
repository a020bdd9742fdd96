"""Which films, instances, hosts and tiles take part: eligibility, sources, null tiles, parts, merges and retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions.prefix import draw_rank
from tilewright.functions.scalars import draw_key
from tilewright.operators import constraints, sampling, spatial
from tilewright.sources.shared import written


def eligible_films(films: DataFrame, val: DataFrame, tainted: DataFrame, grey_steps: DataFrame) -> DataFrame:
    """16-bit labelled films outside val and taint whose grey step is 1; a film without a known step is out.

    ``films``: stem, exposure, dtype, has_label. ``val``, ``tainted``: exposure. ``grey_steps``: stem, step.
    """
    rows = films.where((F.col("dtype") == "uint16") & F.col("has_label"))
    rows = rows.join(val.select("exposure"), "exposure", "left_anti").join(tainted.select("exposure"), "exposure", "left_anti")
    return rows.join(grey_steps.where("step = 1").select("stem"), "stem", "left_semi")


def source_instances(shapes: DataFrame, seams: DataFrame, classes: list[int], elongated: list[int], min_area: float, max_side: float, dilate: float) -> DataFrame:
    """Instances that can be lifted from their film.

    ``shapes``: film, shape, class_id, label, points, height, width. ``seams``: film, points, area. An instance is of a wanted class
    and not tungsten, has three points and the area, keeps three quarters of a pixel off the border and under ``max_side``; one of an
    ``elongated`` class is at least as wide as high. Its centre lies in the film's largest seam and in no other, and no other shape
    of the film comes within ``dilate`` of it.
    """
    box = G.bbox(F.col("points"))
    rows = shapes.withColumn("box", box).withColumn("area", G.polygon_area(F.col("points")))
    b = {k: F.col(f"box.{k}") for k in ("x0", "y0", "x1", "y1")}
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    inside = (b["x0"] >= 0.75) & (b["y0"] >= 0.75) & (b["x1"] <= F.col("width") - 1.75) & (b["y1"] <= F.col("height") - 1.75)
    good = F.col("class_id").isin(classes) & ~F.lower("label").contains("tungsten") & (F.size("points") >= 3) & (F.col("area") >= min_area)
    shaped = F.when(F.col("class_id").isin(elongated), w >= h).otherwise(F.lit(True))
    wanted = rows.where(good & inside & (F.greatest(w, h) <= max_side) & shaped)
    flat = rows.select("film", "shape", *(b[k].alias(k) for k in b))
    near = spatial.clashes(flat, dilate).select("film", "shape").distinct()
    alone = wanted.join(near, ["film", "shape"], "left_anti")
    main = seams.groupBy("film").agg(F.max("area").alias("top"))
    cx, cy = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    placed = alone.join(seams.select("film", F.col("points").alias("seam"), F.col("area").alias("seam_area")), "film").join(main, "film")
    hit = placed.withColumn("in_seam", G.point_in_polygon(cx, cy, F.col("seam")) >= 0)
    return hit.groupBy("film", "shape").agg(F.bool_or(F.col("in_seam") & (F.col("seam_area") == F.col("top"))).alias("main"), F.count_if(F.col("in_seam")).alias("n")).where("main AND n = 1").select("film", "shape")


def isolated_mid_sized(shapes: DataFrame, margin: float, by: str = "class_id") -> DataFrame:
    """Shapes (film, shape, by, area, x0..y1) apart from others by ``margin`` and of middle size: between their class's median and 90th
    percentile of area; a class without such a shape keeps all its isolated ones."""
    bands = shapes.groupBy(by).agg(F.percentile("area", 0.5).alias("lo"), F.percentile("area", 0.9).alias("hi"))
    near = spatial.clashes(shapes, margin).select("film", "shape").distinct()
    alone = shapes.join(near, ["film", "shape"], "left_anti").join(bands, by).withColumn("mid", F.col("area").between(F.col("lo"), F.col("hi")))
    some = alone.groupBy(by).agg(F.bool_or("mid").alias("some"))
    return alone.join(some, by).where("mid OR NOT some").drop("lo", "hi", "mid", "some")


def hosts(films: DataFrame, used: DataFrame, min_width: int) -> DataFrame:
    """Landscape films, wide enough, that have not been used."""
    return films.where((F.col("width") > F.col("height")) & (F.col("width") >= min_width)).join(used.select("film"), "film", "left_anti")


def clear_examples(tiles: DataFrame, cls: int, side: float = 12) -> DataFrame:
    """Tiles with a box of the class of at least ``side`` pixels both ways; if there is none, all tiles with the class."""
    of_class = lambda b: b["class_id"] == cls
    pool = tiles.where(F.exists("boxes", of_class)).withColumn("clear", F.exists("boxes", lambda b: of_class(b) & (b["w"] >= side) & (b["h"] >= side)))
    some = pool.agg(F.bool_or("clear").alias("some"))
    return pool.crossJoin(F.broadcast(some)).where("clear OR NOT some").drop("clear", "some")  # one row


def null_tiles(windows: DataFrame, centres: DataFrame, inserted: DataFrame, holdout: Column, seed: int) -> DataFrame:
    """Windows that hold a null centre and no inserted one, with kind: null, holdout (a draw of ``holdout`` of them) or boxed (they kept
    a real box and are only counted). ``windows``: tile, film, x, y, side, has_box; ``centres``, ``inserted``: film, px, py."""
    rows = spatial.windows_without_point(spatial.windows_with_point(windows, centres), inserted)
    rows = rows.withColumn("__key", draw_key(seed, F.col("tile"))).withColumn("__empty", F.coalesce(~F.col("has_box"), F.lit(False)))
    kind = F.when(F.col("has_box"), "boxed").when(F.col("__empty") & (F.col("__rank") < holdout), "holdout").otherwise("null")
    return draw_rank(rows, "__key", "__rank", ("__empty",)).withColumn("kind", kind).drop("__key", "__rank", "__empty")


def film_host_tiles(windows: DataFrame, centres: DataFrame) -> DataFrame:
    """Windows of host films that hold the centre of a polygon inserted into an implanted film; ``centres`` (film, px, py) name the
    implanted film, whose id holds its host's."""
    from tilewright.functions.labels import host_of

    return spatial.windows_with_point(windows, centres.select(host_of(F.col("film")).alias("film"), "px", "py"))


def balanced_parts(windows: DataFrame, part: str, seed: int, *ids: str) -> DataFrame:
    """Windows with a class above 0 and, of each part, as many clean ones by draw."""
    rows = windows.withColumn("__pos", F.exists("classes", lambda c: c > 0))
    n = rows.where("__pos").groupBy(part).agg(F.count("*").alias("__n"))
    clean = sampling.sample(rows.where("NOT __pos").join(n, part), F.col("__n"), seed, *ids, partition=(part,)).drop("__n")
    return rows.where("__pos").unionByName(clean).drop("__pos")


def assign_parts(tiles: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """``tiles`` with part by exposure: val, test, else train. Overlapping lists are an error."""
    constraints.enforce([constraints.disjoint(val, test, "exposure", "val and test")])
    marks = val.select("exposure", F.lit("val").alias("part")).unionByName(test.select("exposure", F.lit("test").alias("part"))).distinct()
    return tiles.drop("part").join(marks, "exposure", "left").withColumn("part", F.coalesce("part", F.lit("train")))


def carve_test(split: DataFrame, test: DataFrame, key: str = "tile_id") -> DataFrame:
    """A split with some val rows relabelled test; train rows never change."""
    marks = test.select(key, F.lit(True).alias("__t"))
    return split.join(marks, key, "left").withColumn("part", F.when((F.col("part") == "val") & F.col("__t"), "test").otherwise(F.col("part"))).drop("__t")


def merge_checks(parent: DataFrame, child: DataFrame, val: DataFrame) -> list[DataFrame]:
    """What must hold before a child dataset (tile_id, exposure, digest) joins its parent: no val exposures, ids or images in common."""
    return [
        constraints.disjoint(child, val, "exposure", "child has no val exposure"),
        constraints.disjoint(child, parent, "tile_id", "ids differ"),
        constraints.disjoint(child, parent, "digest", "images differ"),
    ]


def merged(parent: DataFrame, child: DataFrame, val: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Parent and child, after the checks; the child is train. With ``taken`` (digest), the SHA-256 of labels that are there already,
    the child's label_text is made byte-unique, its meaning unchanged."""
    from tilewright.functions.labels import unique_labels

    constraints.enforce(merge_checks(parent, child, val))
    if taken is not None:
        own = unique_labels(child, taken, "tile_id").select("tile_id", F.col("text").alias("label_text"))
        child = child.drop("label_text").join(own, "tile_id").select(child.columns)
    return parent.unionByName(child.withColumn("part", F.lit("train")))


def matched_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Instances of two arms with one uid, source and place (uid, source, top, left); an id alone does not make a pair."""
    return left.join(right.select("uid", "source", "top", "left"), ["uid", "source", "top", "left"], "left_semi")


def two_hop(keys: DataFrame, stems: DataFrame, inventory: DataFrame) -> DataFrame:
    """keys (source, film) -> stems (film, stem) -> inventory (stem, ...), unmatched rows kept."""
    return keys.join(stems, "film", "left").join(inventory.withColumn("__found", F.lit(True)), "stem", "left").withColumn("found", F.coalesce("__found", F.lit(False))).drop("__found")


def missing_by_source(joined: DataFrame) -> DataFrame:
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("found")).alias("missing"))


def label_changes(stored: DataFrame, derived: DataFrame, key: str = "tile_id", text: str = "label_text") -> DataFrame:
    """Tiles whose derived label text differs from the stored one in any byte, or is on one side only."""
    both = stored.select(key, F.col(text).alias("__a")).join(derived.select(key, F.col(text).alias("__b")), key, "full")
    return both.where(~F.col("__a").eqNullSafe(F.col("__b"))).select(key, F.col("__a").isNull().alias("new"), F.col("__b").isNull().alias("gone"))


def retry_rounds(pending: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], key: str, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(done, failed): ``attempt(pending, round)`` gives rows with ok; failed ones are tried again. Each round is written once, so
    later rounds never repeat earlier work."""
    done = None
    for k in range(rounds):
        tried = written(attempt(pending, k), "round")
        good = tried.where("ok")
        done = good if done is None else done.unionByName(good)
        pending = written(pending.join(good.select(key), key, "left_anti"), "pending")
        if pending.isEmpty():
            break
    return done, pending


def at_least_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows whose value is at least the median of their group."""
    mid = df.groupBy(by).agg(F.median(value).alias("__mid"))
    return df.join(mid, by).where(F.col(value) >= F.col("__mid")).drop("__mid")


def union_of_shapes(host: DataFrame, inserted: DataFrame) -> DataFrame:
    """(film, shapes): a host's shapes, then the inserted ones; a film with either has a row. Both: film, shapes (one array a film)."""
    none = F.slice("shapes", 1, 0)
    both = host.select("film", "shapes").join(inserted.select("film", F.col("shapes").alias("__new")), "film", "full")
    return both.select("film", F.concat(F.coalesce("shapes", F.slice("__new", 1, 0)), F.coalesce("__new", none)).alias("shapes"))


def standalone_test(tiles: DataFrame, test: DataFrame, key: str = "tile_id") -> DataFrame:
    """The tiles on the test list, whichever part holds them, as part test."""
    return tiles.join(test.select(key), key, "left_semi").withColumn("part", F.lit("test"))


def standalone_test_checks(tiles: DataFrame, test: DataFrame, split: DataFrame, boxes: DataFrame, expected: DataFrame, key: str = "tile_id", cls: str = "cls") -> list[DataFrame]:
    """What must hold of a test set: all its tiles are there, none is a train or val tile of ``split`` (key, part), and its boxes
    (key, cls) count by class as the report ``expected`` (cls, n) says."""
    own = boxes.join(test.select(key), key, "left_semi")
    return [
        constraints.all_in(test, tiles, key, "test tiles are there"),
        constraints.disjoint(test, split.where("part = 'val'"), key, "no val tile"),
        constraints.disjoint(test, split.where("part = 'train'"), key, "no train tile"),
        constraints.same_count(own, expected, cls, "boxes as reported"),
    ]


def not_rendered(tiles: DataFrame, manifest: DataFrame, key: str = "tile_id", digest: str = "digest") -> DataFrame:
    """Tiles that no earlier run has rendered from the same bytes: those of ``manifest`` (key, digest) are reused."""
    return tiles.join(manifest.select(key, digest), [key, digest], "left_anti")
