"""Small codecs with the standard library: TIFF headers and uncompressed grey TIFFs, PNGs, zip members."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, BYTES, PREDICTOR, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 339


def tiff_tags(data: bytes) -> dict[int, list[int]]:
    """Numeric tags of the first directory of a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n, _ = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * k)
        if kind in _CODES:
            size = _SIZES[kind] * n
            where = at + 2 + 12 * k + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 2 + 12 * k + 8)[0]
            tags[tag] = list(struct.unpack_from(order + str(n) + _CODES[kind], data, where))
    return tags


def tiff_shape(data: bytes) -> tuple[int, int, str]:
    """(height, width, dtype) without decoding pixels."""
    t = tiff_tags(data)
    kind = {1: "uint", 2: "int", 3: "float"}.get(t.get(FORMAT, [1])[0], "uint")
    return t[HEIGHT][0], t[WIDTH][0], f"{kind}{t.get(BITS, [1])[0]}"


def tiff_header(read) -> tuple[int, int, str]:
    """(height, width, dtype) of a TIFF of which only the header and the first directory are read: ``read(start, stop)`` gives bytes."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order or len(head) < 8 or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", head[4:8])[0]
    n = struct.unpack(order + "H", read(at, at + 2))[0]
    # the same header with the directory right behind it: sizes, bits and format are in the entries themselves
    near = head[:4] + struct.pack(order + "I", 8)
    entries = read(at + 2, at + 2 + 12 * n)
    kept = [e for e in (entries[i : i + 12] for i in range(0, len(entries), 12)) if struct.unpack(order + "H", e[:2])[0] in (WIDTH, HEIGHT, BITS, FORMAT)]
    return tiff_shape(near + struct.pack(order + "H", len(kept)) + b"".join(kept) + b"\0" * 4)


def packbits(data: bytes) -> bytes:
    """Runs of literal and repeated bytes."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, each width used up to one code before its last."""
    clear, stop = 256, 257
    out, held, bits, at = bytearray(), 0, 0, 0
    table: list[bytes] = []
    width, last = 9, b""
    while True:
        while bits < width:
            if at == len(data):
                return bytes(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFFFF, bits + 8, at + 1
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == stop:
            return bytes(out)
        if code == clear:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError(f"code {code} before it is known")
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1


_DECODERS = {1: bytes, 5: lzw, 8: zlib.decompress, 32773: packbits, 32946: zlib.decompress}


def read_tiff(data: bytes) -> np.ndarray:
    """Pixels of a single-channel TIFF in strips: plain, LZW, deflate or PackBits, with or without horizontal differences; other channel
    counts and codecs are an error."""
    t = tiff_tags(data)
    if t.get(SAMPLES, [1])[0] != 1:
        raise ValueError(f"{t[SAMPLES][0]} channels")
    how, predictor = t.get(COMPRESSION, [1])[0], t.get(PREDICTOR, [1])[0]
    if how not in _DECODERS or predictor not in (1, 2) or STRIPS not in t:
        raise ValueError(f"compression {how} with predictor {predictor} is not supported")
    raw = b"".join(_DECODERS[how](data[a : a + n]) for a, n in zip(t[STRIPS], t[BYTES]))
    h, w, kind = tiff_shape(data)
    image = np.frombuffer(raw, np.dtype(kind).newbyteorder("<" if data[:2] == b"II" else ">"), h * w).reshape(h, w).astype(kind)
    return np.cumsum(image, axis=1, dtype=kind) if predictor == 2 else image


def write_tiff(a: np.ndarray) -> bytes:
    """An uncompressed little-endian grey TIFF."""
    raw = np.ascontiguousarray(a, a.dtype.newbyteorder("<")).tobytes()
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(WIDTH, 4, a.shape[1]), (HEIGHT, 4, a.shape[0]), (BITS, 3, a.dtype.itemsize * 8), (COMPRESSION, 3, 1), (262, 3, 1), (STRIPS, 4, 8), (SAMPLES, 3, 1), (ROWS, 4, a.shape[0]), (BYTES, 4, len(raw)), (FORMAT, 3, kind)]
    entries = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in tags)
    return b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


def write_png(a: np.ndarray) -> bytes:
    """An 8-bit grey or RGB PNG."""
    a = np.ascontiguousarray(a, np.uint8)
    h, w = a.shape[:2]
    rows = a.reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey or RGB PNG without interlace."""
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, color = head[:4]
    if depth != 8 or color not in (0, 2) or head[6]:
        raise ValueError("only 8-bit grey or RGB without interlace")
    c = 1 if color == 0 else 3
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.uint8)
    for y, (f, row) in enumerate(zip(raw[:, 0], raw[:, 1:])):
        if f == 0:
            out[y] = row
        elif f == 2:
            out[y] = row + above
        else:
            cur = np.zeros(w * c + c, int)
            up = np.concatenate([np.zeros(c, int), above.astype(int)])
            for i in range(w * c):
                a, b, k = cur[i], up[i + c], up[i]
                p = a + b - k
                pred = a if f == 1 else (a + b) // 2 if f == 3 else min((a, b, k), key=lambda v: abs(p - v))
                cur[i + c] = (int(row[i]) + pred) & 255
            out[y] = cur[c:]
        above = out[y]
    return out.reshape(h, w) if c == 1 else out.reshape(h, w, 3)


def directory_start(data: bytes) -> int:
    """Where the directory begins in the archive, from the archive's last bytes."""
    end = data.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    return struct.unpack_from("<I", data, end + 16)[0]


def zip_directory(data: bytes, offset: int = 0) -> list[dict]:
    """Members of a zip: name, method, crc, sizes and header place. ``data`` may be the archive's tail, from ``offset`` on."""
    end = data.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    n, _, at = struct.unpack_from("<HII", data, end + 10)
    at -= offset
    out = []
    for _ in range(n):
        method, crc, packed, size, name, extra, comment, place = struct.unpack_from("<10xH4xIIIHHH8xI", data, at)
        out.append({"name": data[at + 46 : at + 46 + name].decode(), "method": method, "crc": crc, "packed": packed, "size": size, "place": place})
        at += 46 + name + extra + comment
    return out


def zip_member(data: bytes, member: dict, offset: int = 0) -> bytes:
    """A member's content, with its size and checksum checked."""
    at = member["place"] - offset
    name, extra = struct.unpack_from("<HH", data, at + 26)
    raw = data[at + 30 + name + extra :][: member["packed"]]
    out = raw if member["method"] == 0 else zlib.decompress(raw, -15)
    if len(out) != member["size"] or zlib.crc32(out) != member["crc"]:
        raise ValueError(f"{member['name']}: size or checksum differs")
    return out
