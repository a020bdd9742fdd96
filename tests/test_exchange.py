"""Ranged archives over HTTP, views, resumed work, registered versions, reports."""

import http.server
import io
import json
import re
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import labels
from tilewright.sources import archives, formats, readers, writers


@pytest.fixture
def server():
    """Serves one archive by ranges and counts what it sent."""
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for k in range(40):
            z.writestr(f"{'ab'[k % 2]}/{k:02d}.bin", bytes([k]) * 5000, zipfile.ZIP_STORED)
    data, sent = body.getvalue(), []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):
            a, b = map(int, re.match(r"bytes=(\d+)-(\d+)", self.headers["Range"]).groups())
            part = data[a : b + 1]
            sent.append((a, b))
            self.send_response(206 if self.path == "/a.zip" else 200)
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", data, sent
    s.shutdown()


def test_archive_over_http(spark, server):
    url, data, sent = server
    rows = {r.name: bytes(r.content) for r in readers.zip_members(spark, f"{url}/a.zip", "^a/(0|1)", extract=True, max_gap=1 << 20).collect()}
    assert rows == {f"a/{k:02d}.bin": bytes([k]) * 5000 for k in range(0, 20, 2)}
    assert sum(b - a for a, b in sent) < 2 * len(data)  # one span, and the directory
    few = readers.zip_members(spark, f"{url}/a.zip", "^a/0[02]", extract=True, max_gap=10)
    assert few.count() == 2
    with pytest.raises(OSError, match="expected a part"):
        archives.read_range(f"{url}/other", 0, 10)


def test_spans_are_bounded(spark):
    rows = spark.createDataFrame([("z", f"m{k}", 0, 1000, 1000, 0, k * 1100) for k in range(100)], "archive string, name string, method int, packed long, size long, crc long, place long")
    assert archives.spans(rows, 200, 1 << 30).count() == 1
    assert archives.spans(rows, 10, 1 << 30).count() == 100
    parts = archives.spans(rows, 200, 11_000).collect()
    assert len(parts) == 10 and sum(len(p.members) for p in parts) == 100


def test_long_directory(tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for k in range(2000):
            z.writestr(f"{'x' * 60}/{k}", b"")
    assert len(archives.directory(str(tmp_path / "big.zip"))) == 2000


def test_header_of_a_big_endian_image():
    import struct

    tags = [(formats.WIDTH, 300), (formats.HEIGHT, 200), (formats.BITS, 16), (formats.FORMAT, 1)]
    entries = b"".join(struct.pack(">HHIHH", t, 3, 1, v, 0) for t, v in tags)
    data = b"MM\0*" + struct.pack(">I", 5000) + b"\1" * 4992 + struct.pack(">H", len(tags)) + entries + b"\0" * 4
    reads = []
    assert formats.tiff_header(lambda a, b: reads.append(b - a) or data[a:b]) == (200, 300, "uint16")
    assert sum(reads) < 100


def test_work_is_resumed(spark, tmp_path):
    rows, done = spark.range(200).select(F.col("id").alias("k")), []

    def work(part):
        done.append(part.count())
        if len(done) == 3:
            raise RuntimeError("lost")
        return part.withColumn("v", F.col("k") + 1)

    with pytest.raises(RuntimeError):
        writers.in_batches(rows, work, str(tmp_path / "w"), "k", 5)
    out = writers.in_batches(rows, work, str(tmp_path / "w"), "k", 5)
    assert len(done) == 6 and sorted(r.v for r in out.collect()) == list(range(1, 201))


def test_versions_and_reports(spark, tmp_path):
    at = str(tmp_path)
    for v in ("v1", "v2"):
        writers.register(spark.range(int(v[1])), at, "set", v, {})
    assert readers.registered(spark, at, "set")[1].count() == 2 and readers.registered(spark, at, "set", "v1")[0]["rows"] == 1
    with pytest.raises(FileNotFoundError):
        readers.registered(spark, at, "set", "v9")
    assert writers.markdown_table(spark.range(5), limit=3).endswith("more than 3 rows |") and "more" not in writers.markdown_table(spark.range(3), limit=3)


def test_labels_that_cannot_be_made_unique(spark):
    text = "0 0.5 0.5 0.1 0.1\n"
    rows = spark.createDataFrame([("a", text), ("b", " \n"), ("c", "1 0.25 0.5 0.1 0.1\n")], "tile string, label_text string")
    taken = rows.where("tile = 'a'").select(F.explode(labels.label_variants(F.col("label_text"))).alias("v")).select(F.sha2("v.text", 256).alias("digest"))
    got = {r.tile: (r.added, r.text) for r in labels.unique_labels(rows, taken).collect()}
    assert got == {"a": (None, None), "b": (0, "\n"), "c": (0, "1 0.25 0.5 0.1 0.1\n")}


def test_labelme_document(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"shapes": [{"label": "crack", "points": [[0, 0], [1, 0], [1, 1]], "flags": None}]}))
    r = readers.labelme(spark, str(tmp_path)).first()
    assert r.class_id == 2 and not r.synthetic


def test_images_without_a_digest(spark, tmp_path):
    (tmp_path / "a b.tif").write_bytes(formats.write_tiff(np.zeros((3, 5), np.uint8)))
    r = readers.image_headers(spark, str(tmp_path), digest=False).first()
    assert (r.height, r.width, r.dtype, r.problem) == (3, 5, "uint8", None)


def lzw_codes(data):
    """A plain encoder."""
    out, bits, width = [], [], 9
    table = {bytes([i]): i for i in range(256)}
    n, word = 258, b""
    bits += [(256, 9)]
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        bits.append((table[word], width))
        table[word + bytes([b])] = n
        n += 1
        if n == 1 << width:
            width += 1
        if n == 4094:
            bits.append((256, width))
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    bits += [(table[word], width)] if word else []
    n += 1
    bits.append((257, width + (n == 1 << width and width < 12)))
    whole = "".join(f"{c:0{w}b}" for c, w in bits)
    whole += "0" * (-len(whole) % 8)
    out = int(whole, 2).to_bytes(len(whole) // 8, "big")
    return out


def test_compressed_images():
    import struct
    import zlib

    rng = np.random.default_rng(3)
    a = np.cumsum(rng.integers(0, 4, (40, 120)), axis=1).astype(np.uint16)
    plain = formats.write_tiff(a)
    diff = np.diff(a, axis=1, prepend=np.uint16(0)).astype("<u2").tobytes()
    packed = b"".join(bytes([len(c) - 1]) + c for c in (diff[i : i + 100] for i in range(0, len(diff), 100)))
    for how, body in ((5, lzw_codes(diff)), (8, zlib.compress(diff)), (32773, packed)):
        tags = [(formats.WIDTH, 120), (formats.HEIGHT, 40), (formats.BITS, 16), (formats.COMPRESSION, how), (formats.STRIPS, 8), (formats.SAMPLES, 1), (formats.BYTES, len(body)), (formats.PREDICTOR, 2), (formats.FORMAT, 1)]
        entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
        data = b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + b"\0" * 4
        assert (formats.read_tiff(data) == a).all(), how
    assert formats.packbits(bytes([254, 7, 128, 1, 5, 6])) == bytes([7, 7, 7, 5, 6])
    assert (formats.read_tiff(plain) == a).all()
    with pytest.raises(ValueError, match="not supported"):
        formats.read_tiff(plain.replace(struct.pack("<HHIHH", formats.COMPRESSION, 3, 1, 1, 0), struct.pack("<HHIHH", formats.COMPRESSION, 3, 1, 7, 0)))
