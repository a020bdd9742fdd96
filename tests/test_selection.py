"""Selection operators on small cases."""

import pytest
from pyspark.sql import functions as F

from tilewright.operators import constraints, selection

SQUARE = lambda x, y, s=10: [(float(x), float(y)), (float(x + s), float(y)), (float(x + s), float(y + s)), (float(x), float(y + s))]
POINTS = "array<struct<x:double,y:double>>"


def test_source_instances(spark):
    shapes = [
        ("f", "good", 0, "porosity", SQUARE(100, 100)),
        ("f", "tungsten", 1, "Tungsten inclusion", SQUARE(200, 100)),
        ("f", "border", 0, "porosity", SQUARE(0, 100)),
        ("f", "outside", 0, "porosity", SQUARE(100, 300)),
        ("f", "near1", 0, "porosity", SQUARE(300, 100)),
        ("f", "near2", 5, "other", SQUARE(314, 100)),
        ("f", "tall", 2, "crack", [(400.0, 90.0), (404.0, 90.0), (404.0, 120.0), (400.0, 120.0)]),
        ("f", "twice", 0, "porosity", SQUARE(600, 100)),
        ("f", "small", 0, "porosity", SQUARE(700, 100, 1)),
    ]
    df = spark.createDataFrame(shapes, f"film string, shape string, class_id int, label string, points {POINTS}").withColumns({"height": F.lit(400), "width": F.lit(900)})
    seams = spark.createDataFrame([("f", [(20.0, 80.0), (880.0, 80.0), (880.0, 140.0), (20.0, 140.0)], 51600.0), ("f", SQUARE(595, 95, 20), 400.0)], f"film string, points {POINTS}, area double")
    got = selection.source_instances(df, seams, [0, 1, 2], [2], 20, 60, 6)
    assert [r.shape for r in got.collect()] == ["good"]


def test_parts_and_merge(spark):
    tiles = spark.createDataFrame([("A_E1__x0", "E1"), ("B_E1__x5", "E1"), ("E2__x0", "E2"), ("E3__x0", "E3")], "tile_id string, exposure string")
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "exposure string")
    got = {r.tile_id: r.part for r in selection.assign_parts(tiles, one("E3"), one("E1")).collect()}
    assert got == {"A_E1__x0": "test", "B_E1__x5": "test", "E2__x0": "train", "E3__x0": "val"}
    with pytest.raises(constraints.Broken, match="val and test"):
        selection.assign_parts(tiles, one("E3", "E1"), one("E1"))
    split = spark.createDataFrame([("a", "val"), ("b", "train")], "tile_id string, part string")
    carved = selection.carve_test(split, spark.createDataFrame([("a",), ("b",)], "tile_id string"))
    assert {r.tile_id: r.part for r in carved.collect()} == {"a": "test", "b": "train"}
    parent = spark.createDataFrame([("p", "E1", "d1", "train")], "tile_id string, exposure string, digest string, part string")
    child = spark.createDataFrame([("c", "E2", "d2")], "tile_id string, exposure string, digest string")
    assert selection.merged(parent, child, one("E3")).count() == 2
    for bad in (("p", "E2", "d2"), ("c", "E3", "d2"), ("c", "E2", "d1")):
        with pytest.raises(constraints.Broken):
            selection.merged(parent, spark.createDataFrame([bad], child.schema), one("E3"))


def test_examples_and_rounds(spark):
    rows = [("a", [(1, 5.0, 5.0)]), ("b", [(1, 20.0, 20.0), (2, 3.0, 3.0)]), ("c", [(2, 4.0, 4.0)])]
    df = spark.createDataFrame(rows, "tile string, boxes array<struct<class_id:int,w:double,h:double>>")
    assert [r.tile for r in selection.clear_examples(df, 1).collect()] == ["b"]
    assert sorted(r.tile for r in selection.clear_examples(df, 2).collect()) == ["b", "c"]
    done, failed = selection.retry_rounds(spark.range(10), lambda p, k: p.withColumn("ok", F.col("id") % 4 == k), "id", rounds=3)
    assert sorted(r.id for r in done.collect()) == [0, 1, 2, 4, 5, 6, 8, 9] and sorted(r.id for r in failed.collect()) == [3, 7]
