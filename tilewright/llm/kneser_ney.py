"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted in Spark, memory-mapped by workers.

Counting. Tokens are 64-bit hashes; in the bigram tables 48 bits of them. Each task counts the bigrams of PACK tokens at a time in
numpy and cuts the sorted result by the top bits of the bigram's key, so a frequent word's bigrams spread over all buckets and a
frequent pair is one record a pack. Packs are dealt by parts, runs of buckets, and sorted; a task streams its parts and merges a
bucket at a time (its size is set by the number of buckets, which grows with the corpus). A part is one file of sorted arrays of
keys and counts, each as narrow as its largest count, with an index of where each bucket's arrays begin. From the merged bigrams
come the follower statistics of each context and the number of contexts of each word, merged and written the same way. The number of
files grows to some thousands only: parts get larger, up to 2 ** MOST_PART buckets.

Scoring. Workers map the files and keep up to MAPPED of them, without a file descriptor each, so no block opens them anew. A block's
distinct keys are looked up in order, so the pages touched are read once a block. Memory is one block of BLOCK tokens, or one
text. Nothing of the model is broadcast but its address and a dozen totals.

The arrays are plain files, so the shared folder must be mounted (``file:`` or no scheme). A task that is run again writes the
same file again and moves it into place.

Results: a null or empty text is its end token alone; without training rows every score is 0; rows with a null id are scored but
not learned from; repeated rows count each time; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import struct
import uuid
import zlib
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C
from tilewright.llm.minhash_dedup import mix

PACK = 3_000_000
BLOCK = 800_000
BUCKET_BYTES = 8 << 20  # of training text for each bucket of bigrams
MOST_PART = 10  # a file holds 2 ** MOST_PART buckets at most
MAPPED = 16_000  # files that a worker keeps mapped
ROWS_A_BATCH = 32  # packs are large rows
CACHE = 500_000

_G = np.uint64(0x9E3779B97F4A7C15)
_CUT = np.uint64(16)
END, BEGIN = (xxhash.xxh3_64_intdigest(x) for x in (b"\n</s>", b"\n<s>"))  # no word holds a line feed
#: kinds of rows while counting
BIGRAMS, UNIGRAMS, CONTEXTS, WORDS, TOTALS = range(5)
#: totals: bigrams seen 1, 2, 3, 4 times; words with 1, 2, 3, 4 contexts; distinct bigrams; tokens; types
N_TOTALS = 11
_ROW = "kind int, bucket int, payload binary, totals array<long>"


class Hasher(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def tokens(self, text: str, begin: bool) -> np.ndarray:
        """[begin,] words, end."""
        if len(self) > CACHE:
            self.clear()
        words = text.encode("utf-8", "surrogatepass").lower().split()
        out = np.empty(len(words) + 1 + begin, np.uint64)
        out[begin:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        if begin:
            out[0] = BEGIN
        return out


def _six(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _join(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def _split(b: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", b)[0]
    sizes, at, out = struct.unpack_from(f"<{n}I", b, 4), 4 + 4 * n, []
    for s in sizes:
        out.append(b[at : at + s])
        at += s
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds the largest."""
    return a.astype(np.min_scalar_type(int(a.max()) if a.size else 0))


def _thin(a: np.ndarray) -> bytes:
    a = _narrow(a)
    return bytes([a.itemsize]) + zlib.compress(a.astype(f"<u{a.itemsize}").tobytes(), 1)


def _unthin(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[1:]), f"<u{b[0]}").astype(np.int64)


def bigram_key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h1 * _G + h2)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, the place of one row of each, and sums of the values by key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], order[first], *(np.add.reduceat(v[order], first) if len(k) else v for v in values)


def _cuts(keys: np.ndarray, bits: int, width: int) -> list[tuple[int, slice]]:
    """Buckets by the top bits of sorted keys of ``width`` bits."""
    of = (keys >> np.uint64(width - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    return [(int(of[a]), slice(a, b)) for a, b in zip(first, [*first[1:], len(of)])]


def _table(rows: list[tuple]) -> list[pa.Array]:
    kinds, buckets, payloads, totals = zip(*rows) if rows else ((), (), (), ())
    return [pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary()), pa.array(totals, pa.list_(pa.int64()))]


_NAMES = ["kind", "bucket", "payload", "totals"]


def _counter(bits: int, bits2: int):
    """Texts -> packs."""

    def pack(texts: list[np.ndarray]) -> list[tuple]:
        seq = np.concatenate(texts)
        word = seq[seq != np.uint64(BEGIN)]
        h, _, n = _summed(word, np.ones(len(word), np.int64))
        rows = [(UNIGRAMS, b, _join(h[s].tobytes(), _thin(n[s])), None) for b, s in _cuts(h, bits2, 64)]
        inner = seq[1:] != np.uint64(BEGIN)
        h1, h2 = seq[:-1][inner] >> _CUT, seq[1:][inner] >> _CUT
        key, at, n = _summed(bigram_key(h1, h2), np.ones(len(h1), np.int64))
        h1, h2 = h1[at], h2[at]
        for b, s in _cuts(key, bits, 64):
            order = np.argsort(h1[s])
            a = h1[s][order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            rows.append((BIGRAMS, b, _join(_six(a[first]), _thin(np.diff([*first, len(a)])), _six(h2[s][order]), _thin(n[s][order])), None))
        return rows

    def run(batches):
        hasher, held, size = Hasher(), [], 0
        for batch in batches:
            for text in C.texts(batch):
                held.append(hasher.tokens(text, True))
                size += len(held[-1])
                if size >= PACK:
                    for row in pack(held):
                        yield pa.RecordBatch.from_arrays(_table([row]), _NAMES)
                    held, size = [], 0
        if held:
            for row in pack(held):
                yield pa.RecordBatch.from_arrays(_table([row]), _NAMES)
        del hasher, held
        C.release()

    return run


def _path(folder: str, kind: str, part: int) -> str:
    return f"{folder}/{part >> 10}/{kind}{part}"


class _File:
    """A part's arrays, bucket after bucket, and at the end the index {bucket: [[place, length, type], ...]} with its size."""

    def __init__(self, folder: str, kind: str, part: int):
        self.path = _path(folder, kind, part)
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        self.tmp, self.index = f"{self.path}.{uuid.uuid4().hex}", {}
        self.f = open(self.tmp, "wb")  # noqa: SIM115  closed by ``close``

    def add(self, bucket: int, *arrays: np.ndarray) -> None:
        places = []
        for a in arrays:
            self.f.write(b"\0" * (-self.f.tell() % 8))
            places.append([self.f.tell(), a.size, a.dtype.str])
            self.f.write(np.ascontiguousarray(a).tobytes())
        self.index[bucket] = places

    def close(self) -> None:
        body = json.dumps(self.index).encode()
        self.f.write(body + struct.pack("<Q", len(body)))
        self.f.close()
        os.replace(self.tmp, self.path)


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _merge_first(kind: int, bucket: int, packs: list[list[bytes]], bits2: int) -> tuple[tuple, list[tuple]]:
    """The packs of one bucket of bigrams or unigrams -> its arrays; totals and, for bigrams, packs of contexts and words."""
    if kind == UNIGRAMS:
        h, _, n = _summed(np.concatenate([np.frombuffer(p[0], np.uint64) for p in packs]), np.concatenate([_unthin(p[1]) for p in packs]))
        return (h, _narrow(n)), [(TOTALS, bucket, None, [0] * 9 + [int(n.sum()), len(h)])]
    h1 = np.concatenate([np.repeat(_unsix(p[0]), _unthin(p[1])) for p in packs])
    h2, n = np.concatenate([_unsix(p[2]) for p in packs]), np.concatenate([_unthin(p[3]) for p in packs])
    key, at, n = _summed(bigram_key(h1, h2), n)
    h1, h2 = h1[at], h2[at]
    rows = [(TOTALS, bucket, None, [*_of_counts(n), 0, 0, 0, 0, len(key), 0, 0])]
    c, _, total, n1, n2, n3 = _summed(h1, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
    rows += [(CONTEXTS, b, _join(_six(c[s]), *(_thin(x[s]) for x in (total, n1, n2, n3))), None) for b, s in _cuts(c, bits2, 48)]
    w, _, many = _summed(h2, np.ones(len(h2), np.int64))
    rows += [(WORDS, b, _join(_six(w[s]), _thin(many[s])), None) for b, s in _cuts(w, bits2, 48)]
    return (key, _narrow(n)), rows


def _merge_second(kind: int, bucket: int, packs: list[list[bytes]], bits2: int) -> tuple[tuple, list[tuple]]:
    """The packs of one bucket of contexts or words -> its arrays, and totals."""
    h, _, *sums = _summed(np.concatenate([_unsix(p[0]) for p in packs]), *(np.concatenate([_unthin(p[i]) for p in packs]) for i in range(1, len(packs[0]))))
    total = [0] * N_TOTALS
    if kind == WORDS:
        total[4:8] = _of_counts(sums[0])
    return (h, *map(_narrow, sums)), [(TOTALS, bucket, None, total)]


_KINDS = {BIGRAMS: "b", UNIGRAMS: "u", CONTEXTS: "c", WORDS: "w"}


def _merged(merge, folder: str, shift: int, bits2: int):
    """Rows sorted by kind and bucket, whole parts to a task -> files, and what ``merge`` passes on; totals are added up."""

    def run(batches):
        total, at, packs, file, part = np.zeros(N_TOTALS, np.int64), None, [], None, None

        def bucket_done():
            nonlocal file, part
            if part != (at[0], at[1] >> shift):
                if file:
                    file.close()
                part = (at[0], at[1] >> shift)
                file = _File(folder, _KINDS[at[0]], part[1])
            arrays, rows = merge(*at, packs, bits2)
            file.add(at[1], *arrays)
            for row in rows:
                if row[0] == TOTALS:
                    total[:] += row[3]
                else:
                    yield pa.RecordBatch.from_arrays(_table([row]), _NAMES)

        for batch in batches:
            for kind, bucket, payload, totals in zip(*(batch.column(c) for c in range(4))):
                kind, bucket = kind.as_py(), bucket.as_py()
                if kind == TOTALS:
                    total += totals.as_py()
                    continue
                if at is not None and at != (kind, bucket):
                    yield from bucket_done()
                    packs = []
                at = (kind, bucket)
                packs.append(_split(payload.as_py()))
        if at is not None:
            yield from bucket_done()
            file.close()
        yield pa.RecordBatch.from_arrays(_table([(TOTALS, 0, None, total.tolist())]), _NAMES)
        del packs
        C.release()

    return run


def discounts(n: list[int]) -> tuple[float, float, float, float]:
    """0 and the discounts of counts 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    out = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a else k / 2)
    return tuple(out)


class Model:
    """Where the arrays are, and the totals."""

    def __init__(self, folder: str, bits: int, bits2: int, shift: int, totals: list[int]):
        self.folder, self.bits, self.bits2, self.shift = folder, bits, bits2, shift
        self.d, self.dw = discounts(totals[:4]), discounts(totals[4:8])
        self.pairs, self.tokens, self.types = totals[8:]
        self.with_contexts = np.array([totals[4], totals[5], max(0, self.types - totals[4] - totals[5])], float)


def _mounted(folder: str) -> str:
    parsed = urlparse(folder)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder for memory-mapped arrays, not {parsed.scheme}:")
    return parsed.path or folder


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all rows of ``docs``."""
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    bits2 = max(1, bits - 2)
    folder = _mounted(C.new_path(docs.sparkSession, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    shift = max(0, min(MOST_PART, bits - 8))  # small corpora have many files of a bucket, for parallel tasks
    dealt = lambda df: df.repartition("kind", F.shiftright("bucket", shift)).sortWithinPartitions("kind", "bucket")
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(min(ROWS_A_BATCH, int(before)) if int(before) > 0 else ROWS_A_BATCH))
    try:
        packs = rows.mapInArrow(_counter(bits, bits2), _ROW)
        first = dealt(packs).mapInArrow(_merged(_merge_first, folder, shift, bits2), _ROW)
        second = dealt(first).mapInArrow(_merged(_merge_second, folder, shift, bits2), _ROW)
        sums = second.agg(*(F.sum(F.col("totals")[i]) for i in range(N_TOTALS))).first()
    finally:
        conf.set(name, before)
    return Model(folder, bits, bits2, shift, [int(x or 0) for x in sums])


class Reader:
    """Looks up sorted keys in a model's arrays."""

    def __init__(self, model: Model):
        self.m, self.open = model, OrderedDict()

    def _part(self, kind: str, part: int):
        """(map, index) of a file, None if there is none."""
        key = (kind, part)
        if key in self.open:
            self.open.move_to_end(key)
            return self.open[key]
        path = _path(self.m.folder, kind, part)
        found = None
        if os.path.exists(path):
            with open(path, "rb") as f:
                whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
            (n,) = struct.unpack_from("<Q", whole, len(whole) - 8)
            found = whole, json.loads(whole[len(whole) - 8 - n : len(whole) - 8])
        self.open[key] = found
        if len(self.open) > MAPPED:
            self.open.popitem(last=False)
        return found

    def _arrays(self, kind: str, bucket: int) -> list[np.ndarray] | None:
        found = self._part(kind, bucket >> self.m.shift)
        places = found[1].get(str(bucket)) if found else None
        return [np.frombuffer(found[0], t, n, at) for at, n, t in places] if places else None

    def find(self, kind: str, keys: np.ndarray, bits: int, width: int, columns: int = 1) -> np.ndarray:
        """What is stored for each of the sorted ``keys``; 0 if nothing."""
        out = np.zeros((len(keys), columns), np.int64)
        for b, s in _cuts(keys, bits, width) if len(keys) else ():
            if arrays := self._arrays(kind, b):
                k, *values = arrays
                at = np.minimum(np.searchsorted(k, keys[s]), len(k) - 1)
                hit = np.flatnonzero(k[at] == keys[s])
                for c, n in enumerate(values):
                    out[s.start + hit, c] = n[at[hit]]
        return out if columns > 1 else out[:, 0]

    def score(self, texts: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """(n_tokens, n_known, base_score, score) of token arrays [begin, words, end]."""
        m, seq = self.m, np.concatenate(texts)
        seen, where = np.unique(seq, return_inverse=True)
        c = self.find("u", seen, m.bits2, 64)
        short, back = np.unique(seen >> _CUT, return_inverse=True)
        many = self.find("w", short, m.bits2, 48)[back]
        context = self.find("c", short, m.bits2, 48, 4)[back]
        d = np.array(m.d)
        with np.errstate(divide="ignore", invalid="ignore"):
            spare = np.where(context[:, 0] > 0, context[:, 1:] @ d[1:] / context[:, 0], 1.0)
        uniform = 1 / (m.types + 1)
        if m.pairs:
            dw = np.array(m.dw)
            low = (np.maximum(many - dw[np.minimum(many, 3)], 0) + dw[1:] @ m.with_contexts * uniform) / m.pairs
        else:
            low = np.full(len(seen), uniform)
        pair = np.flatnonzero(seq[1:] != np.uint64(BEGIN)) + 1
        w, p = where[pair], where[pair - 1]
        keys, inverse = np.unique(bigram_key(seq[pair - 1] >> _CUT, seq[pair] >> _CUT), return_inverse=True)
        n = self.find("b", keys, m.bits, 64)[inverse]
        total = context[p, 0]
        high = np.where(total > 0, np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total, 1), 0.0)
        logs = np.log10(high + spare[p] * low[w])
        base = np.log10((c[w] + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
        size = np.array([len(t) - 1 for t in texts])
        at = np.cumsum(size) - size
        known = np.add.reduceat((c[w] > 0).astype(np.int64), at)
        return list(zip(size.tolist(), known.tolist(), [math.fsum(base[a : a + k]) for a, k in zip(at, size)], np.add.reduceat(logs, at).tolist()))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score, score; perplexity is 10 ** (-score / n_tokens)."""

    def make():
        hasher, reader = Hasher(), Reader(model)

        def f(batch):
            ids, block, size, out = batch.column("doc_id"), [], 0, []
            for text in C.texts(batch):
                block.append(hasher.tokens(text, True))
                size += len(block[-1])
                if size >= BLOCK:
                    out += reader.score(block)
                    block, size = [], 0
            if block:
                out += reader.score(block)
            n, known, base, score = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
            )

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return C.map_batches(rows, make, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = fit(docs.where(C.fold("doc_id", 10) != 0))
    found = scores(docs, model)
    return found.select("doc_id", C.held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")

