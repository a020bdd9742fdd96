"""Scans: images, label documents, line files, tables, zip archives. All are lazy and prune what is not selected."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.geometry import rectangle_corners
from tilewright.functions.scalars import class_of
from tilewright.sources import archives, formats
from tilewright.sources.writers import local

LABELME = "imageHeight long, imageWidth long, imagePath string, shapes array<struct<label:string,points:array<array<double>>,shape_type:string,description:string,flags:map<string,boolean>>>"


def images(spark: SparkSession, root: str) -> DataFrame:
    """path, length of .tif and .tiff files below ``root``, in any case; a missing root is an error. Contents are not read
    unless selected with ``with_content``."""
    return _files(spark, root).select("path", "length")


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.lower("path").rlike(r"\.tiff?$"))


def image_headers(spark: SparkSession, root: str, digest: bool = True) -> DataFrame:
    """path, stem, height, width, dtype, problem and, with ``digest``, sha1: a bad file gives a row with its problem instead of ending
    the job. Without ``digest`` a few hundred bytes of each file are read."""
    names = ["path", *(["sha1"] if digest else []), "height", "width", "dtype", "problem"]

    def shape(path, data):
        return formats.tiff_shape(data) if digest else formats.tiff_header(lambda a, b: archives.read_range(path, a, b))

    def read(batches):
        for b in batches:
            out = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist() if digest else iter(lambda: None, 0)):
                try:
                    out.append((*shape(path, data), None))
                except Exception as e:  # noqa: BLE001  a row's status, whatever is wrong with the file
                    out.append((None, None, None, str(e)[:200]))
            h, w, d, p = zip(*out) if out else ((), (), (), ())
            own = [b.column(c) for c in names[: len(names) - 4]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(h, pa.int64()), pa.array(w, pa.int64()), pa.array(d, pa.string()), pa.array(p, pa.string())], names)

    rows = _files(spark, root).select("path", *([F.sha1("content").alias("sha1"), "content"] if digest else []))
    out = rows.mapInArrow(read, ", ".join(f"{n} {'long' if n in ('height', 'width') else 'string'}" for n in names))
    return out.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1))


def labelme(spark: SparkSession, root: str) -> DataFrame:
    """One row a shape: path, stem, ordinal, label, class_id (null if no target), shape_type, synthetic, points. Two points of a
    rectangle become four; shapes without points go. Files without shapes give no row."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    docs = docs.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", LABELME).alias("d"))
    rows = docs.select("path", F.posexplode("d.shapes").alias("ordinal", "s"))
    points = F.transform("s.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rows = rows.select("path", "ordinal", F.trim("s.label").alias("label"), F.col("s.shape_type").alias("shape_type"), F.coalesce(F.try_element_at("s.flags", F.lit("synthetic")), F.lit(False)).alias("synthetic"), points.alias("points"))
    rows = rows.where(F.size("points") > 0).withColumn("points", rectangle_corners(F.col("points")))
    return rows.withColumn("class_id", class_of(F.col("label"))).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def yolo_labels(spark: SparkSession, root: str, tiles: DataFrame | None = None) -> DataFrame:
    """One row a file: tile, boxes array<struct<class_id, cx, cy, w, h>>. Blank lines do not count. File sources skip empty files,
    so negatives come from ``tiles`` (tile), the tiles that have a label file: those without rows get no boxes."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda s: F.trim(s) != "")

    def box(s):
        p = F.split(F.trim(s), r"\s+")
        return F.struct(F.get(p, 0).try_cast("int").alias("class_id"), *(F.get(p, i).try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)))

    tile = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
    rows = files.select(tile.alias("tile"), F.transform(lines, box).alias("boxes"))
    if tiles is None:
        return rows
    empty = F.expr("CAST(array() AS array<struct<class_id:int,cx:double,cy:double,w:double,h:double>>)")
    return tiles.select("tile").join(rows, "tile", "left").select("tile", F.coalesce("boxes", empty).alias("boxes"))


def epoch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with stripped header cells; values as doubles where they parse, else null beside their text in ``raw``."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.select(*(F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in df.columns), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("raw"))


def film_list(spark: SparkSession, path: str) -> DataFrame:
    """key: lines without comments and blanks, the first ``__`` of each as ``/``."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("key")).where("key <> ''")
    return lines.select(F.regexp_replace("key", "^(.*?)__", "$1/").alias("key"))


def zip_members(spark: SparkSession, path: str, pattern: str | None = None, extract: bool = False, max_gap: int = 1 << 20) -> DataFrame:
    """name, method, size, crc and, if ``extract``, content of the members of zip archives (files, or an address); ``pattern`` filters
    names first. Archives are read by ranges, never whole."""
    found = archives.members(archives.archives(spark, path), pattern)
    if extract:
        return archives.contents(found, max_gap)
    return found.select("archive", "name", "method", "size", "crc", F.lit(None).cast("binary").alias("content"))


def data_yaml(path: str) -> dict:
    """What ``writers.data_yaml`` wrote: root, parts, names by class id, params. A driver's small document of plain keys and values."""
    import json

    out: dict = {"parts": {}, "names": {}, "params": {}}
    block = None
    for line in local(path).read_text(encoding="utf-8").splitlines():
        key, _, value = line.strip().partition(":")
        value = value.strip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not line.startswith(" "):
            block = key if not value else None
            if key == "path":
                out["root"] = value
            elif value:
                out["parts"][key] = value
        elif block == "names":
            out["names"][int(key)] = value
        elif block == "params":
            out["params"][key] = json.loads(value)
    return out


def registered(spark: SparkSession, path: str, name: str, version: str | None = None) -> tuple[dict, DataFrame]:
    """(document, rows) of a dataset version that ``writers.register`` wrote; the newest by name if none is given."""
    import json

    folder = local(f"{path}/{name}")
    found = sorted(p.parent.name for p in folder.glob("*/dataset.json"))
    if not found or version not in (None, *found):
        raise FileNotFoundError(f"no version {version or ''} of {name} in {path}")
    version = version or found[-1]
    return json.loads((folder / version / "dataset.json").read_text(encoding="utf-8")), spark.read.parquet(f"{path}/{name}/{version}/data")
