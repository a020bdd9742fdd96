"""Readers and writers on small folders."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import films
from tilewright.sources import formats, readers, writers
from tilewright.streaming import tiles as stream


def test_tiff_and_png_round_trip():
    a = np.random.default_rng(0).integers(0, 65535, (13, 17)).astype(np.uint16)
    data = formats.write_tiff(a)
    assert formats.tiff_shape(data) == (13, 17, "uint16") and (formats.read_tiff(data) == a).all()
    for b in (a.astype(np.uint8), np.random.default_rng(1).integers(0, 255, (5, 6, 3)).astype(np.uint8)):
        assert (formats.read_png(formats.write_png(b)) == b).all()
    with pytest.raises(ValueError, match="TIFF"):
        formats.tiff_shape(b"nonsense")


def test_image_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A_f1.TIF").write_bytes(formats.write_tiff(np.zeros((4, 9), np.uint16)))
    (tmp_path / "bad.tiff").write_bytes(b"junk")
    (tmp_path / "other.png").write_bytes(b"x")
    assert readers.images(spark, str(tmp_path)).count() == 2
    rows = {r.stem: r for r in readers.image_headers(spark, str(tmp_path)).collect()}
    assert (rows["A_f1"].height, rows["A_f1"].width, rows["A_f1"].dtype) == (4, 9, "uint16")
    assert rows["bad"].problem and len(rows["bad"].sha1) == 40
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.images(spark, str(tmp_path / "none")).count()


def test_labelme(spark, tmp_path):
    doc = {"imageHeight": 10, "imageWidth": 20, "imagePath": "f.tif", "shapes": [
        {"label": " crack ", "points": [[1, 2], [3, 5]], "shape_type": "rectangle", "flags": {"synthetic": True}},
        {"label": "weld", "points": [[0, 0], [9, 0], [9, 9]], "shape_type": "polygon"},
        {"label": "porosity", "points": [], "shape_type": "polygon"},
    ]}
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "g.json").write_text(json.dumps({"shapes": []}))
    rows = readers.labelme(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.stem, r.label, r.class_id, r.synthetic, len(r.points)) for r in rows] == [("f", "crack", 2, True, 4), ("f", "weld", None, False, 3)]


def test_lines_and_tables(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "t1.txt").write_text("3 0.5 0.5 0.1 0.2\n\n1 0.1 0.2 0.3 0.4\n")
    (tmp_path / "labels" / "t2.txt").write_text("")
    rows = {r.tile: r.boxes for r in readers.yolo_labels(spark, str(tmp_path / "labels"), spark.createDataFrame([("t1",), ("t2",)], "tile string")).collect()}
    assert [b.class_id for b in rows["t1"]] == [3, 1] and rows["t2"] == []
    (tmp_path / "m.csv").write_text(" epoch, metrics/mAP50(B)\n1, 0.5\n2, n/a\n")
    got = readers.epoch_metrics(spark, str(tmp_path / "m.csv")).collect()
    assert [r["metrics/mAP50(B)"] for r in got] == [0.5, None] and "n/a" in got[1].raw
    (tmp_path / "list.txt").write_text("# all\na__b__c\n\nplain # note\n")
    assert [r.key for r in readers.film_list(spark, str(tmp_path / "list.txt")).collect()] == ["a/b__c", "plain"]


def test_zip(spark, tmp_path):
    at = tmp_path / "a.zip"
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("x/one.txt", b"one" * 100, zipfile.ZIP_DEFLATED)
        z.writestr("x/two.txt", b"two", zipfile.ZIP_STORED)
        z.writestr("y/three.bin", b"3")
    rows = {r.name: bytes(r.content) for r in readers.zip_members(spark, str(at), "^x/", extract=True).collect()}
    assert rows == {"x/one.txt": b"one" * 100, "x/two.txt": b"two"}
    data = at.read_bytes()
    members = formats.zip_directory(data)
    broken = bytearray(data)
    broken[members[1]["place"] + 30 + len("x/two.txt")] ^= 1
    with pytest.raises(ValueError, match="two"):
        formats.zip_member(bytes(broken), members[1])



def test_writers(spark, tmp_path):
    film = np.random.default_rng(0).integers(0, 65535, (64, 64)).astype(np.uint16)
    tile = [("t1", "train", 0, 0, 40, "0 0.5 0.5 0.1 0.1\n"), ("t2", "val", 20, 20, 40, "")]
    df = spark.createDataFrame([(bytearray(formats.write_tiff(film)), tile)], "content binary, tiles array<struct<tile:string,part:string,x:int,y:int,side:int,label_text:string>>")
    png = films.render(df)
    done = lambda: {r.tile: r.reused for r in writers.tile_folder(png, str(tmp_path)).collect()}
    assert done() == {"t1": False, "t2": False} and done() == {"t1": True, "t2": True}
    assert (tmp_path / "labels/train/t1.txt").read_text().endswith("0.1\n") and (tmp_path / "labels/val/t2.txt").read_text() == ""
    assert formats.read_png((tmp_path / "images/val/t2.png").read_bytes()).shape == (40, 40)
    boxes = spark.createDataFrame([([(1, 0.5, 0.25, 0.1, 0.2)],), ([],)], "boxes array<struct<class_id:int,cx:double,cy:double,w:double,h:double>>")
    assert [r.t for r in boxes.select(writers.label_text().alias("t")).collect()] == ["1 0.500000 0.250000 0.100000 0.200000\n", ""]
    writers.repeat_list(spark.createDataFrame([("a", 2), ("b", 0)], "line string, copies int"), str(tmp_path / "rep"), "line")
    assert [r.value for r in spark.read.text(str(tmp_path / "rep")).collect()] == ["a", "a"]
    writers.register(spark.range(3), str(tmp_path), "set", "v1", {"t": 1})
    assert json.loads((tmp_path / "set/v1/dataset.json").read_text())["rows"] == 3
    writers.data_yaml(str(tmp_path / "d.yaml"), "root", ["a", "b"], {"train": "images/train"}, {"seed": 0})
    assert "  1: b" in (tmp_path / "d.yaml").read_text()
    assert writers.markdown_table(spark.range(1)).startswith("| id |")


def test_film_operators(spark):
    pts = [(10.0, 10.0), (30.0, 10.0), (30.0, 30.0), (10.0, 30.0)]
    pairs = spark.createDataFrame([("t", 2, 0, pts, 0, 0, 100), ("t", 2, 1, [(500.0, 500.0), (520.0, 500.0), (520.0, 520.0)], 0, 0, 100)], "tile string, class_id int, ordinal int, points array<struct<x:double,y:double>>, x int, y int, side int")
    assert [tuple(r)[3:7] for r in films.tile_boxes(pairs).collect()] == [(10, 10, 31, 31)]
    y = np.arange(700)
    profile = (30000 + 20000 * np.maximum(0, 1 - ((y - 350) / 200) ** 2)).tolist()
    got = {r.stem: r for r in films.beads(spark.createDataFrame([("a", profile), ("b", [1.0] * 700)], "stem string, profile array<double>")).collect()}
    assert abs(got["a"].centre - 350) < 4 and got["b"].centre is None
    yy, xx = np.mgrid[:60, :60]
    disc = ((yy - 15) ** 2 + (xx - 15) ** 2 < 36) | ((yy - 42) ** 2 + (xx - 42) ** 2 < 36)
    rows = [("d", 60, 60, np.where(disc, 20000.0, 30000.0).ravel().tolist(), disc.ravel().tolist())]
    out = films.instance_contrasts(spark.createDataFrame(rows, "stem string, height int, width int, pixels array<double>, mask array<boolean>")).collect()
    assert [r.contrast for r in out] == [-10000, -10000]


def test_stream(spark, tmp_path):
    rows = [("a", True, "2024-01-01 00:00:00"), ("b", False, "2024-01-01 00:01:00"), ("a", True, "2024-01-01 00:00:00")]
    src = spark.createDataFrame(rows, "tile string, has_box boolean, t string").withColumn("t", F.col("t").cast("timestamp"))
    src.write.json(str(tmp_path / "in"))
    s = stream.tile_stream(spark, str(tmp_path / "in"), "tile string, has_box boolean, t timestamp")
    for _ in range(2):  # a second run adds nothing
        stream.append(stream.first_seen(s, "t", "1 hour", "tile"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.tile for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    q = stream.running_counts(s).writeStream.format("memory").queryName("n_tiles").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("n_tiles").first()) == (3, 2)
