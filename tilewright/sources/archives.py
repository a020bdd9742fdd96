"""Zip archives read by byte ranges, locally or over HTTP: the directory from the archive's end, members in spans.

No archive is read whole. Members that lie close together are fetched with one request, a task a span; a span's bytes are bounded,
so memory does not grow with the archive.
"""

from __future__ import annotations

import os
import urllib.request
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.windows import gap_islands
from tilewright.sources import formats

TAIL = 1 << 16
LOCAL_HEADER = 30 + TAIL  # a member's header, with the longest extra field, before its data


def size_of(url: str) -> int:
    """Bytes of a file or of what a server offers."""
    if urlparse(url).scheme in ("http", "https"):
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as r:
            return int(r.headers["Content-Length"])
    return os.path.getsize(_mounted(url))


def read_range(url: str, start: int, stop: int) -> bytes:
    """Bytes start .. stop - 1; a server that does not answer with that part is an error."""
    if urlparse(url).scheme in ("http", "https"):
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={start}-{stop - 1}"}), timeout=600) as r:
            if r.status != 206:
                raise OSError(f"{url}: expected a part, got status {r.status}")
            return r.read()
    with open(_mounted(url), "rb") as f:
        f.seek(start)
        return f.read(stop - start)


def _mounted(url: str) -> str:
    p = urlparse(url)
    if p.scheme not in ("", "file"):
        raise OSError(f"{url}: ranges are read from mounted folders and HTTP servers")
    return unquote(p.path) if p.scheme else url


def directory(url: str) -> list[dict]:
    """Members of an archive, from its last bytes and, where the directory is longer, the bytes before them."""
    size = size_of(url)
    start = max(0, size - TAIL - 22)
    tail = read_range(url, start, size)
    first = formats.directory_start(tail)
    if first < start:
        tail, start = read_range(url, first, start) + tail, first
    return formats.zip_directory(tail, start)


_MEMBER = "archive string, name string, method int, packed long, size long, crc long, place long"


def members(archives: DataFrame, pattern: str | None = None) -> DataFrame:
    """(archive, name, method, packed, size, crc, place) of the members of ``archives`` (path) whose name matches ``pattern``."""

    def read(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = [{"archive": path, **m} for m in directory(path)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("archive", pa.string()), ("name", pa.string()), ("method", pa.int32()), ("packed", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("place", pa.int64())]))

    found = archives.select("path").mapInArrow(read, _MEMBER)
    return found.where(F.col("name").rlike(pattern)) if pattern else found


def spans(rows: DataFrame, max_gap: int, most: int) -> DataFrame:
    """(archive, start, stop, members): members at most ``max_gap`` bytes apart in one span, of about ``most`` bytes."""
    end = F.col("place") + 30 + F.octet_length("name") + F.col("packed")
    runs = gap_islands(rows, ["archive"], "place", end, ["place", "name"], max_gap)
    one = F.struct("name", "method", "packed", "size", "crc", "place")
    return runs.groupBy("archive", "island", F.floor(F.col("place") / most).alias("__part")).agg(F.min("place").alias("start"), F.max(F.col("place") + LOCAL_HEADER + F.col("packed")).alias("stop"), F.collect_list(one).alias("members")).drop("island", "__part")


def contents(rows: DataFrame, max_gap: int = 1 << 20, most: int = 64 << 20) -> DataFrame:
    """(archive, name, method, size, crc, content) of ``members``: one request a span, each member checked."""
    schema = pa.schema([("archive", pa.string()), ("name", pa.string()), ("method", pa.int32()), ("size", pa.int64()), ("crc", pa.int64()), ("content", pa.binary())])

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                data = read_range(r["archive"], r["start"], min(r["stop"], size_of(r["archive"])))
                for m in r["members"]:
                    body = formats.zip_member(data, m, r["start"])
                    yield pa.RecordBatch.from_pylist([{"archive": r["archive"], "name": m["name"], "method": m["method"], "size": m["size"], "crc": m["crc"], "content": body}], schema)

    return spans(rows, max_gap, most).repartition("archive", "start").mapInArrow(read, "archive string, name string, method int, size long, crc long, content binary")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the archives at ``path``, or of addresses, one row each; contents are not read."""
    if urlparse(path).scheme in ("http", "https"):
        return spark.createDataFrame([(path,)], "path string")
    return spark.read.format("binaryFile").load(path).select("path")
