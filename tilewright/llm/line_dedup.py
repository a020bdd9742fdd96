"""Line dedup: first occurrences of line hashes, streamed from range partitions, returned as keep bitmaps.

1. Each text gives one row for each distinct line key of at least MIN_KEY code points: its 128-bit hash, the document, and the
   places of its lines.
2. The rows, written once so that texts are parsed once, are range-partitioned by (hash, document) with a secondary sort by place. As the document is part of the range
   key, a line that a third of all documents hold is spread over many partitions.
3. Each sorted partition is streamed once. The first document of a hash keeps its lines and the later ones drop theirs. Only
   the first hash of a partition may have begun in an earlier one; its rows are written as pending, and the owner of each
   partition's last hash, which may go on in the next one, is written too. The smallest document of both is found by a
   pre-aggregated minimum over at most two hashes a partition, which is small enough to broadcast.
4. The places to drop, gathered for each document, become a compressed bitmap of the lines to keep.

Texts move once, when ``apply_bitmaps`` joins them to their bitmaps by document.

Results: a null or empty text is one empty line, which is kept; a null id takes no part: its row keeps all lines and makes no
other row lose any; rows that repeat an id are one document, whose lines stay or go together; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C

BLANKS = " \t\n\v\f\r"
MIN_KEY = 10
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(_LOWER)


def pack(n_lines: int, drop: list[int]) -> bytes:
    """A bitmap of the lines to keep."""
    keep = np.ones(n_lines, bool)
    keep[drop] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _rows_of(min_key: int):
    """Batches (doc_id, text_key, text) -> one row for each line key of a document."""

    def f(batch):
        h1, h2, row, n, places, first = [], [], [], [], [], []
        for r, text in enumerate(C.texts(batch)):
            lines, found = text.split("\n"), {}
            for i, line in enumerate(lines):
                key = line_key(line)
                if len(key) >= min_key:
                    found.setdefault(key, []).append(i)
            for key, at in found.items():
                d = xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))
                h1.append(int.from_bytes(d[:8], "big", signed=True))
                h2.append(int.from_bytes(d[8:], "big", signed=True))
                row.append(r)
                n.append(len(lines))
                places.append(at)
                first.append(at[0])
        take = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(n, pa.int32()), pa.array(first, pa.int32()), pa.array(places, pa.list_(pa.int32()))],
            ["h1", "h2", "doc_id", "text_key", "n_lines", "first", "places"],
        )

    return f


def _stream():
    """Sorted batches -> rows to drop, the pending rows of the partition's first hash, and the owner of its last hash, without places."""
    names = ["h1", "h2", "doc_id", "text_key", "n_lines", "places", "pending"]

    def f(batches):
        head = last = doc_before = like = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.empty(len(h1), bool)
            new[0] = last != (h1[0], h2[0])
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))  # where each row's hash begins; -1: in an earlier batch
            owner = np.where(at >= 0, doc[at], doc_before if doc_before is not None else doc[0])
            if head is None:
                head = (h1[0], h2[0])
            pending = (h1 == head[0]) & (h2 == head[1])
            last, doc_before, like = (h1[-1], h2[-1]), owner[-1], batch.schema
            out = np.flatnonzero(pending | (owner != doc))
            if len(out):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(out)) for c in names[:-1]), pa.array(pending[out])], names)
        if last is not None:
            one = [pa.array([int(x)], pa.int64()) for x in (*last, doc_before)]
            yield pa.RecordBatch.from_arrays([*one, *(pa.nulls(1, like.field(c).type) for c in names[3:6]), pa.array([True])], names)
            C.release()

    return f


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep) of the documents that lose a line; text_key is xxhash64 of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    lines = C.map_batches(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), lambda: _rows_of(min_key), "h1 long, h2 long, doc_id long, text_key long, n_lines int, first int, places array<int>")
    lines = C.written(lines, "line-hashes")  # the range sampler reads its input once more
    dealt = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "first")
    marks = C.written(dealt.mapInArrow(_stream(), "h1 long, h2 long, doc_id long, text_key long, n_lines int, places array<int>, pending boolean"), "line-marks")
    pending = marks.where("pending")
    owners = pending.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))  # two hashes a partition at most
    late = pending.where("places IS NOT NULL").join(F.broadcast(owners), ["h1", "h2"]).where(F.col("doc_id") != F.col("owner"))
    drops = marks.where("NOT pending").select("doc_id", "text_key", "n_lines", "places").unionByName(late.select("doc_id", "text_key", "n_lines", "places"))
    gathered = drops.groupBy("doc_id", "text_key", "n_lines").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("drop"))

    def make():
        def f(batch):
            n, drop = batch.column("n_lines").to_pylist(), batch.column("drop").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(map(len, drop), pa.int64()), pa.array(list(map(pack, n, drop)), pa.binary())],
                ["doc_id", "text_key", "n_lines", "n_dropped", "keep"],
            )

        return f

    return C.map_batches(gathered, make, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with __n_lines, __n_dropped and __text, the kept lines."""
    rows = docs.select(*keep, F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__whole"))
    maps = bitmaps.select(F.col("doc_id").alias("__b_id"), F.col("text_key").alias("__b_key"), F.col("keep").alias("__keep"))
    both = rows.join(maps, (F.col("__id") == F.col("__b_id")) & (F.col("__key") == F.col("__b_key")), "left").select(*keep, "__whole", "__keep")

    def make():
        def f(batch):
            n, dropped, out = [], [], []
            for text, bitmap in zip(batch.column("__whole").to_pylist(), batch.column("__keep").to_pylist()):
                lines = text.split("\n")
                stay = [x for x, k in zip(lines, unpack(bitmap, len(lines))) if k] if bitmap else lines
                n.append(len(lines))
                dropped.append(len(lines) - len(stay))
                out.append("\n".join(stay) if bitmap else text)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], [*keep, "__n_lines", "__n_dropped", "__text"])

        return f

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return C.map_batches(both, make, f"{kept}, __n_lines long, __n_dropped long, __text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("__text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, (o.owner IS NOT NULL AND k.doc_id IS NOT NULL AND k.doc_id <> o.owner) AS gone FROM k LEFT JOIN o USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
