"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; decoding without loss.

The lattice of a text has an arc for every piece of the vocabulary that matches there, and byte pieces for a character that is no
piece. An arc weighs (1 + r) ** -ALPHA, r being the piece's rank (the model's own scores are ranks). Forward filtering sums the
weights of all paths to each node; backward sampling draws, from the end, an arc into the node in proportion to what it brings.
Pieces never span the cuts before a run of spaces and around a line feed, so the lattice falls into units and the forward sums
of a unit are computed once for all its occurrences in a block.

The numbers drawn are a hash of the row's key, the unit's place and the step, and the arcs into a node are ordered by their length:
the same row gives the same pieces whatever else is in its block, whichever units a worker has met before.
In the lattice a space is the mark of the pieces, so a literal U+2581 is spelled in bytes and decoding returns every text.

One pass, no shuffle; memory is one block of BLOCK characters, or one text.

Results: a null or empty text has no pieces (null decodes to the empty text); rows with equal keys and texts get equal pieces;
a null key is a key like any other; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C
from tilewright.llm.minhash_dedup import mix
from tilewright.llm.token_counts import model_path

ALPHA = 1.0
BLOCK = 500_000
CACHE = 120_000  # units whose lattices a worker keeps
FILTER_BITS = 22

_G, _H = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Numbers(dict):
    """unit -> its number, in the order seen."""

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


class Pieces:
    """The vocabulary as a table of hashed prefixes, with the ids of those that are pieces."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        pieces: dict[str, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.bytes_of[i], self.byte_id[b] = bytes([b]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                t = sp.id_to_piece(i).replace("▁", " ")
                self.bytes_of[i] = t.encode()
                pieces[t] = i
        rank = np.array([min(-sp.get_score(i), n) if sp.get_score(i) <= 0 else 0 for i in range(n)], float)
        self.log_weight = -alpha * np.log1p(np.maximum(rank, 0))
        self.byte_weight = -alpha * np.log1p(n)
        apart = not any(" " in t.lstrip(" ") or "\n" in t for t in pieces)
        self.units = re.compile(r" *[^ \n]+| +|\n" if apart else r"(?s).+").findall
        self.longest = max(map(len, pieces))
        table: dict[int, int] = {}
        for t, i in pieces.items():
            h = 0
            for k, c in enumerate(t, 1):
                h = (h * int(_G) + ord(c)) & 0xFFFFFFFFFFFFFFFF
                key = (h + k * int(_H)) & 0xFFFFFFFFFFFFFFFF
                table.setdefault(key, -1)
                if k == len(t):
                    table[key] = i
        keys = mix(np.array(list(table), np.uint64))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(table.values()), np.int32)[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def arcs(self, c: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of all pieces in code points ``c``; ``end``: of the unit of each place. id -1 spells bytes."""
        alive, h = np.arange(len(c)), np.zeros(len(c), np.uint64)
        starts, sizes, ids = [], [], []
        wide = c.astype(np.uint64)
        for k in range(1, self.longest + 1):
            ok = alive + k <= end[alive]
            alive = alive[ok]
            h = h[ok] * _G + wide[alive + (k - 1)]
            key = mix(h + np.uint64(k * int(_H) % (1 << 64)))
            ok = self.filter[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
            alive, h, key = alive[ok], h[ok], key[ok]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == key
            alive, h, i = alive[ok], h[ok], self.ids[at[ok]]
            is_piece = i >= 0
            if k == 1:
                spelled = np.ones(len(c), bool)
                spelled[alive[is_piece]] = False
                starts.append(np.flatnonzero(spelled))
                sizes.append(np.ones(len(starts[0]), np.int64))
                ids.append(np.full(len(starts[0]), -1, np.int32))
            starts.append(alive[is_piece])
            sizes.append(np.full(len(starts[-1]), k, np.int64))
            ids.append(i[is_piece])
            if not len(alive):
                break
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)


class Lattice:
    """Units with their arcs sorted by end node and each arc's share of what reaches that node, summed up within the node.

    A unit of n characters has the nodes base .. base + n.
    """

    def __init__(self, pieces: Pieces, units: list[str]):
        size = np.array([len(u) for u in units], np.int64)
        c = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(np.arange(len(units)), size)
        first = np.cumsum(size) - size
        start, length, ids = pieces.arcs(c, np.repeat(first + size, size))
        self.base = first + np.arange(len(units))
        self.last = self.base + size
        node = start + of[start]
        stop = node + length
        step = start - first[of[start]] + length  # of the end within its unit
        # by step, then end; stable, as the order of the arcs into one node (by length) decides which of them a draw selects
        order = np.argsort(step * (len(c) + len(units) + 1) + stop, kind="stable")
        node, stop, step, start, ids = node[order], stop[order], step[order], start[order], ids[order]
        # characters spelled in bytes
        spelled = np.flatnonzero(ids < 0)
        raw = [chr(x).encode("utf-8", "surrogatepass") for x in c[start[spelled]].tolist()]
        many = np.ones(len(ids), np.int64)
        many[spelled] = [len(b) for b in raw]
        self.id_first = (np.cumsum(many) - many).astype(np.int32)
        self.id_many = many.astype(np.int8)
        self.ids = np.repeat(ids, many)
        if raw:
            at = np.repeat(self.id_first[spelled] - np.cumsum(many[spelled]) + many[spelled], many[spelled]) + np.arange(many[spelled].sum())
            self.ids[at] = pieces.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        weight = np.where(ids >= 0, pieces.log_weight[np.maximum(ids, 0)], pieces.byte_weight * many)
        # forward sums, a step at a time
        alpha = np.zeros(len(c) + len(units))
        share = np.empty(len(ids))
        cuts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]])) if len(step) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            value, ends = alpha[node[a:b]] + weight[a:b], stop[a:b]
            head = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            n = np.diff([*head, b - a])
            top = np.maximum.reduceat(value, head)
            part = np.exp(value - np.repeat(top, n))
            total = np.add.reduceat(part, head)
            alpha[ends[head]] = top + np.log(total)
            share[a:b] = part / np.repeat(total, n)
        self.start = node.astype(np.int32)
        head = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]])) if len(stop) else np.empty(0, np.int64)
        self.arc_first = np.zeros(len(alpha), np.int32)
        self.arc_first[stop[head]] = head
        n = np.diff([*head, len(stop)])
        self.up_to = share  # summed within each node, so that the sums don't depend on what else is in the block
        for k in range(1, n.max() if len(n) else 1):
            at = head[n > k] + k
            self.up_to[at] += self.up_to[at - 1]
        if len(head):
            self.up_to[head + n - 1] = 2.0  # the last arc takes what rounding leaves

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of a sampled path for each occurrence, one after another, and how many each has. ``key`` seeds the draws."""
        node, floor = self.last[unit], self.base[unit]
        active = np.arange(len(unit))
        taken, count, step = [], np.zeros(len(unit), np.int64), 0
        while len(active):
            u = (mix(key[active] + np.uint64((step + 1) * int(_G) % (1 << 64))) >> np.uint64(11)) * 2.0**-53
            arc = self.arc_first[node]
            more = np.flatnonzero(u >= self.up_to[arc])
            while len(more):
                arc[more] += 1
                more = more[u[more] >= self.up_to[arc[more]]]
            taken.append((active, arc))
            count[active] += 1
            node = self.start[arc]
            go = node != floor
            active, node, floor, step = active[go], node[go], floor[go], step + 1
        end = np.cumsum(count)
        out = np.empty(end[-1] if len(end) else 0, np.int64)
        for k, (occurrence, arc) in enumerate(taken):
            out[end[occurrence] - 1 - k] = arc
        return out, count


class Codec:
    """Keeps the lattices of the first CACHE units that it sees; later ones are built anew for each block."""

    def __init__(self, path: str, alpha: float = ALPHA):
        self.pieces = Pieces(path, alpha)
        self.numbers, self.kept = _Numbers(), []

    def _lattices(self):
        """(first number, lattice) of all units that have a number now; forgets the numbers over CACHE."""
        known = sum(n for n, _ in self.kept)
        if len(self.numbers) > known:
            new = list(itertools.islice(self.numbers, known, None))
            added = (len(new), Lattice(self.pieces, new))
        else:
            added = None
        first = 0
        for n, lattice in [*self.kept, added] if added else self.kept:
            yield first, first + n, lattice
            first += n
        if added:
            if first <= CACHE:
                self.kept.append(added)
            else:
                for unit in new:
                    del self.numbers[unit]

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of the texts, one after another, and how many each text has. ``keys``: uint64, one a row."""
        per_text, found = [], []
        for t in texts:
            units = self.pieces.units(" " + t) if t else []
            found.append(np.fromiter(map(self.numbers.__getitem__, units), np.int32, len(units)))
            per_text.append(len(units))
        unit = np.concatenate(found) if found else np.empty(0, np.int32)
        per_text = np.array(per_text, np.int64)
        if not len(unit):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        place = np.arange(len(unit)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        key = mix(np.repeat(mix(keys + _H), per_text) + place.astype(np.uint64) * _H)
        size, parts = np.zeros(len(unit), np.int64), []
        for a, b, lattice in self._lattices():
            own = np.flatnonzero((unit >= a) & (unit < b))
            if len(own):
                arcs, count = lattice.sample(unit[own] - a, key[own])
                many = lattice.id_many[arcs].astype(np.int64)
                at = np.repeat(lattice.id_first[arcs] - np.cumsum(many) + many, many) + np.arange(many.sum())
                ends = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(count)])]
                size[own] = np.diff(ends)
                parts.append((own, ends, lattice.ids[at]))
        start = np.cumsum(size) - size
        out = np.empty(size.sum(), np.int32)
        for own, ends, ids in parts:
            out[np.repeat(start[own] - ends[:-1], size[own]) + np.arange(len(ids))] = ids
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(per_text)])]
        return out, np.diff(ends)

    def decode(self, ids) -> str:
        """The text of piece ids, as encoded: without the space put before it."""
        return b"".join(map(self.pieces.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def _blocks(texts: list[str]):
    a = n = 0
    for b, t in enumerate(texts):
        if n and n + len(t) > BLOCK:
            yield a, b
            a, n = b, 0
        n += len(t)
    yield a, len(texts)


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), key_col: str = "doc_id", text_col: str = "text", path: str | None = None, alpha: float = ALPHA, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """The columns ``keep`` with n_pieces, piece_ids (null unless ``with_ids``), ids_sha256 (of little-endian 32-bit ids) and
    lossless: whether the ids decode to the text."""
    path = path or model_path()
    rows = docs.select(*keep, F.xxhash64(F.col(key_col), F.lit(seed)).alias("__key"), F.col(text_col).cast("string").alias("__whole"))
    names = [*keep, "n_pieces", "piece_ids", "ids_sha256", "lossless"]

    def make():
        codec = Codec(path, alpha)

        def f(batch):
            texts, keys = C.texts(batch, "__whole"), batch.column("__key").to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b in _blocks(texts):
                ids, many = codec.encode(texts[a:b], keys[a:b])
                ends = np.concatenate([[0], np.cumsum(many)])
                sha, same = [], []
                for t, s, e in zip(texts[a:b], ends[:-1], ends[1:]):
                    own = ids[s:e]
                    sha.append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
                    same.append(codec.decode(own.tolist()) == t)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())) if with_ids else pa.nulls(b - a, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in keep), pa.array(many, pa.int64()), lists, pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names)

        return f

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return C.map_batches(rows, make, f"{kept}, n_pieces long, piece_ids array<int>, ids_sha256 string, lossless boolean")


def decode(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "piece_ids", path: str | None = None) -> DataFrame:
    """The columns ``keep`` with text: what the piece ids stand for; null ids give the empty text."""
    path = path or model_path()
    rows = rows.select(*keep, F.col(ids_col).alias("__ids"))

    def make():
        codec = Codec(path)

        def f(batch):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([codec.decode(x or ()) for x in batch.column("__ids").to_pylist()], pa.string())], [*keep, "text"])

        return f

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return C.map_batches(rows, make, f"{kept}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids; ``lossless`` comes from decoding them."""
    return encode(C.documents(spark, sf_dir), with_ids=False).drop("piece_ids")
