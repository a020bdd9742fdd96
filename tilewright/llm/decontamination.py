"""Benchmark decontamination: q-gram lemma filter over overlapping diagonal bands, then banded alignment.

Texts and items are lower-cased and their white space is collapsed. An item of m characters counts as contained if some part of
the text is within e = RATE * m edits of it. Such a part shares at least m - Q + 1 - Q * e of the item's q-grams, all on at most
e + 1 neighbouring diagonals (text place - item place). So shared q-grams are counted in cells of e + 1 diagonals, two
neighbouring cells make a band, and a band below the bound holds no match. What is left is verified by an alignment of the
whole item within the band, many candidates at once. For short items e is lowered until the bound is 1. Items of fewer than Q
characters allow no edit; an automaton finds them where they stand as whole words (inside of words such strings occur by chance).

The benchmark is a stated query set: it is broadcast in blocks of at most BLOCK_ITEMS characters (or one item), each a pass over the
texts, which are never shuffled. Between blocks what was found is written and the block is given back, so at most one block is
held, however large the benchmark. Memory is one chunk of texts, or one text.

Results: a null or empty text contains nothing; items that are null or blank are not searched; equal items are all reported; a null
id keeps its row, its matches being those of its own text; repeated rows are searched each; empty tables give no matches. Extra
columns are ignored.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C
from tilewright.llm.minhash_dedup import mix

Q = 8
RATE = 0.1
BLOCK_ITEMS = 4_000_000  # characters of items broadcast at once
CHUNK = 2_000_000  # characters of text searched at once
FILTER_BITS = 22
AT_ONCE = 1 << 22  # cells of alignment kept at once

_A = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each Q = 8 characters in a row."""
    h, power = c.astype(np.uint64), np.full(1, _A)
    for k in (1, 2, 4):
        if len(h) <= k:
            return np.empty(0, np.uint64)
        h = h[:-k] * power + h[k:]
        power = power * power
    return mix(h)


def budget(m: int) -> int:
    """Edits allowed for an item of m characters."""
    return min(int(RATE * m), (m - Q) // Q)


class Index:
    """The q-grams of normalised items."""

    def __init__(self, items: list[tuple[int, str]]):
        whole = [(i, normal(t)) for i, t in items]
        self.short = ahocorasick.Automaton()
        by_text: dict[str, list[int]] = {}
        for i, t in whole:
            if 0 < len(t) < Q:
                by_text.setdefault(t, []).append(i)
        for t, ids in by_text.items():
            self.short.add_word(f" {t} ", ids)
        if by_text:
            self.short.make_automaton()
        kept = [(i, t) for i, t in whole if len(t) >= Q]
        self.ids = [i for i, _ in kept]
        self.codes = [code_points(t) for _, t in kept]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([budget(m) for m in self.size], np.int64)
        self.bound = np.maximum(1, self.size - Q + 1 - Q * self.edits)
        grams = [qgrams(c) for c in self.codes]
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(kept)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        self.keys, self.first, self.many = h[first], first, np.diff([*first, len(h)])
        self.item, self.at = item[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands of code points ``c`` that reach the bound."""
        h = qgrams(c)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[maybe])
        key[key == len(self.keys)] = 0
        hit = self.keys[key] == h[maybe]
        place, key = maybe[hit], key[hit]
        n = self.many[key]
        entry = np.repeat(self.first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.item[entry]
        width = self.edits[item] + 1
        shift = 1 << 34
        cell, count = np.unique(item * (shift * 2) + (np.repeat(place, n) - self.at[entry]) // width + shift, return_counts=True)
        after = np.zeros(len(cell), np.int64)  # hits in the next cell
        after[:-1] = np.where(cell[1:] == cell[:-1] + 1, count[1:], 0)
        band, total = cell, count + after
        lone = np.ones(len(cell), bool)  # a cell whose predecessor is empty also ends a band that begins there
        lone[1:] = cell[1:] != cell[:-1] + 1
        band, total = np.concatenate([band, cell[lone] - 1]), np.concatenate([total, count[lone]])
        item = (band + 1) // (shift * 2)
        good = total >= self.bound[item]
        band, item = band[good], item[good]
        return item, (band - item * (shift * 2) - shift) * (self.edits[item] + 1)

    def distances(self, c: np.ndarray, item: int, diagonal: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least edits between the item and a part of ``c[lo:hi]``, in the bands that begin at ``diagonal``, widened by the edits."""
        p, e = self.codes[item], int(self.edits[item])
        m, width = len(p), 4 * e + 3
        out = np.empty(len(diagonal), np.int64)
        step = max(1, AT_ONCE // (m + width))
        for s in range(0, len(diagonal), step):
            j = (diagonal[s : s + step] - e)[:, None] + np.arange(m + width)
            inside = (j >= lo[s : s + step, None]) & (j < hi[s : s + step, None])
            text = np.where(inside, c[np.clip(j, 0, len(c) - 1)], 0)  # outside the document nothing matches
            d = np.zeros((len(j), width + 1), np.int32)
            d[:, -1] = 1 << 20
            ramp = np.arange(width, dtype=np.int32)
            for i in range(m):
                new = np.minimum(d[:, :-1] + (text[:, i : i + width] != p[i]), d[:, 1:] + 1)
                d[:, :-1] = np.minimum.accumulate(new - ramp, axis=1) + ramp
            out[s : s + step] = d[:, :-1].min(1)
        return out

    def search(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each normalised text the (item id, edits) it contains."""
        found: list[dict[int, int]] = [{} for _ in texts]
        if len(self.short):
            for own, t in zip(found, texts):
                for _, ids in self.short.iter(f" {t} "):
                    own.update(dict.fromkeys(ids, 0))
        size = np.array([len(t) + 1 for t in texts])
        start = np.cumsum(size) - size
        c = code_points("\n".join(texts))
        if not len(self.keys) or len(c) < Q:
            return [sorted(x.items()) for x in found]
        item, diagonal = self.candidates(c)
        for k in np.unique(item):
            at = diagonal[item == k]
            first = np.searchsorted(start, at, side="right") - 1  # a band may reach into the next documents
            last = np.searchsorted(start, at + self.size[k] + 2 * self.edits[k] + 2, side="right") - 1
            at, doc = zip(*((a, d) for a, f, z in zip(at, first, last) for d in range(max(0, f), max(0, z) + 1)))
            at, doc = np.array(at), np.array(doc)
            for d, x in zip(doc, self.distances(c, int(k), at, start[doc], start[doc] + size[doc] - 1)):
                if x <= self.edits[k]:
                    own = found[d]
                    own[self.ids[k]] = min(int(x), own.get(self.ids[k], 1 << 30))
        return [sorted(x.items()) for x in found]


def _chunks(texts: list[str]):
    chunk, n = [], 0
    for t in map(normal, texts):
        if n and n + len(t) > CHUNK:
            yield chunk
            chunk, n = [], 0
        chunk.append(t)
        n += len(t)
    if chunk:
        yield chunk


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The items in blocks by a hash of their ids, of at most BLOCK_ITEMS characters but for a single item."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    part = lambda n: F.pmod(F.xxhash64("id", "text"), F.lit(n))
    n = 1
    while rows.groupBy(part(n)).agg(F.sum(F.length("text")).alias("size"), F.count_distinct("id", "text").alias("items")).where((F.col("size") > BLOCK_ITEMS) & (F.col("items") > 1)).count():
        n *= 2
    for k in range(n):
        yield k == n - 1, [(r.id, r.text) for r in rows.where(part(n) == k).distinct().orderBy("id", "text").collect()]


def with_leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row with __leaks: array<struct<item_id, edits>>."""
    out = docs.select(*keep, F.col(text_col).cast("string").alias("__whole"), F.expr("CAST(array() AS array<struct<item_id:bigint,edits:bigint>>)").alias("__leaks"))
    names = [*keep, "__whole", "__leaks"]
    schema = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())]))
    for last, items in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make(shared=shared):
            index = Index(shared.value)

            def f(batch):
                texts = C.texts(batch, "__whole")
                found = [x for chunk in _chunks(texts) for x in index.search(chunk)]
                leaks = [(old or []) + [{"item_id": i, "edits": e} for i, e in new] for old, new in zip(batch.column("__leaks").to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(leaks, kind)], names)

            return f

        out = C.map_batches(out, make, schema)
        if not last:
            out = C.written(out, "leaks")
            shared.destroy()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.size("__leaks").cast("long").alias("n_items"),
        (F.size("__leaks") > 0).alias("contaminated"),
        F.array_sort(F.transform("__leaks", lambda x: x["item_id"])).alias("item_ids"),
        F.array_min(F.transform("__leaks", lambda x: x["edits"])).alias("least_edits"),
    )
