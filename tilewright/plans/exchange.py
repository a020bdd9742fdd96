"""Catalogue queries that go out through a sink, file or stream and come back through a source.

The folders of files hold one for each nation (25 rows at every scale); tables and streams are the whole ones.
"""

from __future__ import annotations

import zipfile

import numpy as np
from pyspark.sql import functions as F

from tilewright.operators import audit, windows
from tilewright.plans.inputs import table
from tilewright.plans.registry import query
from tilewright.sources import formats, readers, writers
from tilewright.sources.shared import scratch, written
from tilewright.streaming import tiles as streams


def _nations(spark, sf):
    return [(r.n_nationkey, r.n_name) for r in table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]


def _folder(spark, tag):
    at = writers.local(scratch(spark, tag))
    at.mkdir(parents=True)
    return at


@query("SELECT concat('n', n_nationkey) AS stem, (10 + n_nationkey) AS height, (20 + 2 * n_nationkey) AS width, 'uint16' AS dtype, 134 + 2 * (10 + n_nationkey) * (20 + 2 * n_nationkey) AS length FROM nation")
def image_inventory(spark, sf):
    """Images by their headers, of which a few bytes are read."""
    at = _folder(spark, "images")
    for k, _ in _nations(spark, sf):
        (at / f"n{k}.TIF").write_bytes(formats.write_tiff(np.zeros((10 + k, 20 + 2 * k), np.uint16)))
    found = readers.image_headers(spark, f"file://{at}", digest=False)
    return found.join(readers.images(spark, f"file://{at}"), "path").select("stem", "height", "width", "dtype", "length")


@query("SELECT concat('n', n_nationkey) AS stem, sha1(repeat(chr(65 + n_nationkey::INT), 100)) AS sha1, 'not a classic TIFF' AS problem FROM nation")
def broken_images(spark, sf):
    """Files that are no images give rows with their problem."""
    at = _folder(spark, "broken")
    for k, _ in _nations(spark, sf):
        (at / f"n{k}.tiff").write_bytes(bytes([65 + k]) * 100)
    return readers.image_headers(spark, f"file://{at}").select("stem", "sha1", "problem")


@query("SELECT concat('n', n_nationkey) AS stem, k AS ordinal, CASE k WHEN 0 THEN 'crack' ELSE n_name END AS label, CASE k WHEN 0 THEN 2 END AS class_id, k = 0 AS synthetic, 4 AS n_points, (n_nationkey + 3.0)::DOUBLE AS right_x FROM nation, (SELECT unnest([0, 1]) AS k)")
def labelme_shapes(spark, sf):
    """A rectangle of a target class and a polygon of another label in each document."""
    at = _folder(spark, "labelme")
    for k, name in _nations(spark, sf):
        shapes = [{"label": " crack ", "points": [[k, 2], [k + 3, 5]], "shape_type": "rectangle", "flags": {"synthetic": True}}, {"label": name, "points": [[0, 0], [k + 3, 0], [k + 3, 9], [0, 9]], "shape_type": "polygon"}]
        writers.json_summary({"imageHeight": 10, "imageWidth": 20, "imagePath": f"n{k}.tif", "shapes": [*shapes, {"label": "crack", "points": []}]}, f"{at}/n{k}.json")
    rows = readers.labelme(spark, f"file://{at}")
    return rows.select("stem", "ordinal", "label", "class_id", "synthetic", F.size("points").alias("n_points"), F.array_max(F.transform("points", lambda p: p["x"])).alias("right_x"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_lines_round_trip(spark, sf):
    at = scratch(spark, "lines")
    writers.json_lines(table(spark, sf, "customer"), at)
    return readers.json_lines(spark, at, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT n_name AS name, n_nationkey AS k FROM nation")
def json_document(spark, sf):
    at = _folder(spark, "document")
    writers.json_summary({"rows": [{"k": k, "name": name} for k, name in _nations(spark, sf)]}, f"{at}/report.json")
    return readers.json_document(spark, f"file://{at}/report.json", "rows array<struct<k:long,name:string>>").select(F.inline("rows")).select("name", "k")


def _tile_rows(spark, sf):
    k = F.col("n_nationkey")
    box = F.struct((k % 6).cast("int").alias("class_id"), F.lit(0.5).alias("cx"), F.lit(0.25).alias("cy"), (k / 100).alias("w"), F.lit(0.125).alias("h"))
    rows = table(spark, sf, "nation").select(F.concat(F.lit("t"), k).alias("tile"), F.when(k % 4 == 0, "val").otherwise("train").alias("part"), F.when(k % 3 == 0, F.slice(F.array(box), 1, 0)).otherwise(F.array(box)).alias("boxes"))
    return rows.withColumn("label_text", writers.label_text()).withColumn("png", F.lit(formats.write_png(np.zeros((4, 4), np.uint8))))


def _tile_folder(spark, sf):
    at = _folder(spark, "tiles")
    return at, written(writers.tile_folder(_tile_rows(spark, sf), f"file://{at}"), "tiles-done")


@query("SELECT concat('t', n_nationkey) AS tile, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 6 END AS cls, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey / 100.0::DOUBLE END AS w, false AS reused FROM nation")
def tile_folder_round_trip(spark, sf):
    at, done = _tile_folder(spark, sf)
    found = readers.yolo_labels(spark, f"file://{at}/labels", done.select("tile"))
    return found.join(done.select("tile", "reused"), "tile").select("tile", F.get("boxes", 0)["class_id"].alias("cls"), F.get("boxes", 0)["w"].alias("w"), "reused")


@query("SELECT concat('t', n_nationkey) AS tile, true AS reused FROM nation")
def tile_folder_again(spark, sf):
    """A second run finds every image with the same bytes."""
    at, _ = _tile_folder(spark, sf)
    return writers.tile_folder(_tile_rows(spark, sf), f"file://{at}").select("tile", "reused")


@query("SELECT concat('t', n_nationkey) AS tile, CASE WHEN n_nationkey % 2 = 0 THEN 'test' ELSE 'train' END AS part FROM nation WHERE n_nationkey % 3 > 0")
def view_links(spark, sf):
    """A view with other parts than its dataset, read through its links; empty labels have no rows."""
    at, done = _tile_folder(spark, sf)
    view = _folder(spark, "view")
    even = F.substring("tile", 2, 9).cast("int") % 2 == 0
    written(writers.symlink_view(done.select("tile", F.col("part").alias("stored"), F.when(even, "test").otherwise("train").alias("part")), f"file://{at}", f"file://{view}"), "view-done")
    read = lambda part: readers.yolo_labels(spark, f"file://{view}/labels/{part}").select("tile", F.lit(part).alias("part"))
    return read("test").unionByName(read("train"))


@query("SELECT n_nationkey::DOUBLE AS epoch, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey / 10.0::DOUBLE END AS map50 FROM nation")
def metrics_table(spark, sf):
    at = _folder(spark, "metrics")
    lines = [" epoch, metrics/mAP50(B) ", *(f"{k}, {'n/a' if k % 5 == 0 else k / 10}" for k, _ in _nations(spark, sf))]
    (at / "results.csv").write_text("\n".join(lines) + "\n")
    return readers.epoch_metrics(spark, f"file://{at}/results.csv").select("epoch", F.col("metrics/mAP50(B)").alias("map50"))


@query("SELECT concat('a', n_nationkey, '/b__c') AS key FROM nation")
def film_list_keys(spark, sf):
    at = _folder(spark, "films")
    (at / "films.txt").write_text("# films\n" + "".join(f"a{k}__b__c  # {name}\n\n" for k, name in _nations(spark, sf)))
    return readers.film_list(spark, f"file://{at}/films.txt")


@query("SELECT concat('x/', n_nationkey, '.txt') AS name, 100 * length(n_name) AS size, sha1(repeat(n_name, 100)) AS digest FROM nation WHERE n_nationkey % 2 = 0")
def archive_contents(spark, sf):
    """Members of one folder of an archive, read in spans."""
    at = _folder(spark, "archive")
    with zipfile.ZipFile(at / "a.zip", "w") as z:
        for k, name in _nations(spark, sf):
            z.writestr(f"{'xy'[k % 2]}/{k}.txt", name * 100, zipfile.ZIP_DEFLATED if k % 4 else zipfile.ZIP_STORED)
    return readers.zip_members(spark, f"file://{at}/a.zip", "^x/", extract=True, max_gap=64).select("name", "size", F.sha1("content").alias("digest"))


@query("SELECT o_orderkey::VARCHAR AS line, o_orderkey % 4 AS n FROM orders WHERE o_orderkey % 4 > 0")
def repeated_lines(spark, sf):
    at = scratch(spark, "repeats")
    writers.repeat_list(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("line"), (F.col("o_orderkey") % 4).alias("copies")), at, "line")
    return spark.read.text(at).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS n_rows, 'v2' AS version FROM orders")
def registered_dataset(spark, sf):
    """The newest of two versions."""
    at = scratch(spark, "registry")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    writers.register(rows.where("o_orderstatus = 'F'"), at, "films", "v1", {"seed": 1})
    writers.register(rows, at, "films", "v2", {"seed": 2}, partition=("o_orderstatus",))
    document, back = readers.registered(spark, at, "films")
    return back.select("o_orderkey", "o_orderstatus", F.lit(document["rows"]).cast("long").alias("n_rows"), F.lit(document["version"]).alias("version"))


@query("SELECT n_nationkey AS id, n_name AS name, 'images/val' AS val, 7 AS seed FROM nation")
def data_file(spark, sf):
    at = f"{_folder(spark, 'data')}/data.yaml"
    names = [name for _, name in _nations(spark, sf)]
    writers.data_yaml(at, "root", names, {"train": "images/train", "val": "images/val"}, {"seed": 7})
    back = readers.data_yaml(at)
    return spark.createDataFrame([(k, v, back["parts"]["val"], back["params"]["seed"]) for k, v in back["names"].items()], "id long, name string, val string, seed long")


@query("SELECT event_id, event_id * 2 AS twice FROM events")
def resumed_batches(spark, sf):
    """Work in eight parts; a second call finds them all."""
    at = scratch(spark, "progress")
    rows = table(spark, sf, "events").select("event_id")
    for work in (lambda r: r.withColumn("twice", F.col("event_id") * 2), lambda r: r.withColumn("twice", F.lit(-1).cast("long"))):
        out = writers.in_batches(rows, work, at, "event_id", 8)
    return out


@query("SELECT event_type, count(*) AS n_tiles, count(*) FILTER (value > 50) AS positive FROM events GROUP BY 1")
def stream_counts(spark, sf):
    source, out = scratch(spark, "stream"), scratch(spark, "stream-name").rsplit("-", 1)[1]
    table(spark, sf, "events").select("event_type", (F.col("value") > 50).alias("has_box")).write.json(source)
    rows = streams.tile_stream(spark, source, "event_type string, has_box boolean")
    run = streams.running_counts(rows, "event_type").writeStream.format("memory").queryName(f"counts_{out}").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(f"counts_{out}")


@query("SELECT DISTINCT event_id FROM events")
def stream_first_seen(spark, sf):
    """Every event arrives twice and is kept once; a second run adds nothing."""
    source, out, marks = scratch(spark, "seen"), scratch(spark, "seen-out"), scratch(spark, "seen-marks")
    rows = table(spark, sf, "events").select("event_id", F.timestamp_seconds(1_700_000_000 + F.col("event_id") % 600).alias("t"))
    rows.unionAll(rows).write.json(source)
    stream = streams.tile_stream(spark, source, "event_id long, t timestamp")
    for _ in range(2):
        streams.append(streams.first_seen(stream, "t", "1 hour", "event_id"), out, marks).awaitTermination()
    return spark.read.parquet(out).select("event_id")


@query("SELECT n_name AS tile FROM (SELECT n_name, k, row_number() OVER (ORDER BY k) AS place FROM (SELECT n_name, n_nationkey + 1 AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS first FROM nation) WHERE k <= 4 OR first = 1) WHERE place <= 8")
def coverage_pick(spark, sf):
    rows = [(r.n_name, {r.n_regionkey}) for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]
    return spark.createDataFrame([(x,) for x in windows.coverage_pick(rows)], "tile string")


@query("SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_nationkey IN (1, 2) AND c_custkey % 3 = 0 OR c_custkey IN (7, 17, 27)")
def catalogue_films(spark, sf):
    """Films of two customers with an annotation of the use case, or on a list."""
    c = table(spark, sf, "customer")
    notes = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("x"))).otherwise(F.slice(F.array(F.lit("x")), 1, 0))
    rows = c.select(F.col("c_nationkey").cast("string").alias("customer_id"), F.col("c_custkey").cast("string").alias("_id"), F.array(F.struct(F.lit("u").alias("use_case"), notes.alias("annotations"))).alias("use_cases"))
    return audit.catalogue_filter(rows, ["1", "2"], "u", ["7", "17", "27"]).select(F.col("_id").alias("id"))
