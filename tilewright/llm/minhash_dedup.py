"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges, confirmed on full sets.

1. A document's set is its distinct word shingles as 64-bit hashes. One permutation gives its signature: the smallest hash in
   each of BINS equal ranges, an empty bin taking the value of a full one that a fixed random probe sequence finds first
   (optimal densification). BANDS groups of ROWS bins are hashed into bucket keys.
2. Documents with one set are one node, so groups of copies cost one node; the node is their smallest id.
3. In a bucket every node is linked to the smallest node only: one edge a node and bucket, never all pairs.
4. Links are confirmed in rounds: first each node's most frequent centre; then the other edges between different components and,
   in buckets that hold several components, edges to a centre drawn anew, until a round does not halve the pairs left or few are.
   Members meet their centre's full set in groups of at most about GROUP, the centre's set being copied to each of them. At last
   all pairs of different components that share a bucket and were not tried are compared, unless their sizes and the shingles that
   no other node has keep them below the bound, or their sketches (two bits of each bin) differ more than those of a pair at the
   bound do with probability 1e-9 (six deviations). In buckets of at most SMALL nodes such pairs are rows. Nodes of larger
   buckets meet in blocks of about GROUP, whose tasks hold the full sets and give links only; that takes the square of a
   bucket's unlinked nodes in time, but not in rows.
5. Components come from alternating large-star and small-star steps; each step is written to the shared folder.

A key with many rows (a centre of many members, one set of many copies) is no hot partition: ``keyed`` joins the rows of keys over a
share of all rows to a broadcast table, of MOST_HOT keys at most by that share, and deals out the others.

At similarity 0.8 a pair shares no bucket with probability (1 - 0.8^ROWS)^BANDS = 3e-6 and 11 buckets on average.

Results: a text without words (or null) has an empty set and is linked with nothing; with fewer words than a shingle the
whole sequence is one; a null id is linked with nothing and is kept (its component is null); rows that repeat an id are one
document; equal similarities at the bound count as links; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C

BIN_BITS = 8
BINS, BANDS, ROWS = 1 << BIN_BITS, 42, 6
GROUP = 256
SMALL = 64  # nodes of a bucket whose pairs may become rows
LEAST_HOT, MOST_HOT = 1_000, 100_000
REST = 4  # pairs for each row of the buckets, under which all that are left are compared at once
CACHE = 300_000

_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """word -> 64-bit hash, and from there the sets of texts."""

    def __init__(self, k: int):
        self.k = k

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def set_of(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes; bytes.split and bytes.lower know ASCII only."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.k + 1)
        s = np.full(n, np.uint64(min(self.k, len(h))))
        for i in range(min(self.k, len(h))):
            s = mix(s * _G + h[i : i + n])
        return np.unique(s)


def _probe(step: int, bins: np.ndarray) -> np.ndarray:
    return (mix(bins.astype(np.uint64) * _G + np.uint64((step + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def bands_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of a sorted, non-empty set, and its sketch: two bits of each bin, 32 bins a word."""
    at = (s >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    value, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[at[first]], full[at[first]] = s[first], True
    empty, step, filled = np.flatnonzero(~full), 0, value.copy()
    while len(empty):
        to = _probe(step, empty)
        ok = full[to]
        filled[empty[ok]] = value[to[ok]]
        empty, step = empty[~ok], step + 1
    rows = filled[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * _G + rows[:, r])
    pairs = (filled & np.uint64(3)).reshape(-1, 32) << (2 * np.arange(32, dtype=np.uint64))
    return keys, np.bitwise_or.reduce(pairs, axis=1)


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, k1 and k2 (hash of the set; null without one), bands and sketch."""

    def make():
        shingler = Shingler(shingle)

        def f(batch):
            n, keys, bands, sketches = [], [], [], []
            for text in C.texts(batch):
                s = shingler.set_of(text)
                n.append(len(s))
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (None, None))
                band, sketch = bands_of(s) if len(s) else (None, None)
                bands.append(band.view(np.int64) if len(s) else None)
                sketches.append(sketch.view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
            )

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return C.map_batches(rows, make, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes) of the documents ``ids``: texts move once, the same way at every size."""

    def make():
        shingler = Shingler(shingle)

        def f(batch):
            found = [shingler.set_of(x).tobytes() for x in C.texts(batch)]
            for i in range(0, len(found), 1024):  # sets are larger than texts
                yield pa.RecordBatch.from_arrays([batch.column("id")[i : i + 1024], pa.array(found[i : i + 1024], pa.binary())], ["id", "hashes"])

        return f

    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    return C.map_batches(texts.join(ids.hint("merge"), "id", "left_semi"), make, "id long, hashes binary")


def _local(spark: SparkSession, rows: list, names: list[str]) -> DataFrame:
    """Collected rows of longs as a table of the plan: no task runs Python to make it."""
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)}))


def keyed(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has a row a key (none with a null). Both are written tables."""
    least = max(LEAST_HOT, rows.count() // MOST_HOT)
    hot = rows.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > least).select(*key).collect()  # fewer than MOST_HOT keys
    if not hot:
        return rows.join(table, key, how)
    hot = _local(rows.sparkSession, hot, key)
    few = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, how)
    return few.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))


def unlike(a: Column, b: Column) -> Column:
    """In how many bins two sketches differ."""
    total = F.lit(0)
    for i in range(BINS // 32):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def most_unlike(percent: int) -> int:
    """Six deviations over the mean of ``unlike`` at the bound; bins that differ agree in two bits with probability 1/4."""
    p = 0.75 * (1 - percent / 100)
    return math.ceil(BINS * p + 6 * math.sqrt(BINS * p * (1 - p)))


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, c; a written table) whose full sets are similar enough. ``sets``: id, hashes. Centres of more members
    than GROUP, and than a share of all pairs that at most MOST_HOT can have, are known to all tasks; their members are dealt out."""
    least = max(GROUP, pairs.count() // MOST_HOT)
    hot = pairs.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()  # fewer than MOST_HOT keys
    salts = _local(pairs.sparkSession, [(r.c, math.ceil(r.n / GROUP)) for r in hot], ["c", "salts"])
    dealt = pairs.join(F.broadcast(salts), "c", "left").select("a", "c", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).alias("salt"))
    members = dealt.select(F.col("a").alias("id"), "c", "salt", F.lit(1).alias("part"))
    centres = dealt.select(F.col("c").alias("id"), "c", "salt", F.lit(0).alias("part")).distinct()

    def check():
        state: dict = {"key": None, "sets": []}

        def f(batch):
            a, c = [], []
            for i, k, salt, part, hashes in zip(*(batch.column(x).to_pylist() for x in ("id", "c", "salt", "part", "hashes"))):
                s = np.frombuffer(hashes, np.uint64)
                if state["key"] != (k, salt):
                    state["key"], state["sets"] = (k, salt), []
                if part == 0:
                    state["sets"].append(s)
                    continue
                for centre in state["sets"]:
                    if not len(s) or not len(centre):
                        continue
                    at = np.searchsorted(centre, s)
                    at[at == len(centre)] = 0
                    both = int(np.count_nonzero(centre[at] == s))
                    if 100 * both >= percent * (len(s) + len(centre) - both):
                        a.append(i)
                        c.append(k)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "c"])

        return f

    full = sets.join(members.unionByName(centres).hint("merge"), "id").select("id", "c", "salt", "part", "hashes")
    return C.map_batches(full.repartition("c", "salt").sortWithinPartitions("c", "salt", "part"), check, "a long, c long")


def settled(parents: DataFrame) -> DataFrame:
    """(id, root) from (id, root) in which every root is a smaller node or the node itself: pointers are doubled until none moves."""
    now = C.written(parents.select("id", "root", F.lit(True).alias("moved")), "near-roots")
    while not now.where("moved").isEmpty():
        up = now.select(F.col("id").alias("root"), F.col("root").alias("__up"))
        old, now = now, C.written(now.select("id", "root").join(up, "root").select("id", F.col("__up").alias("root"), (F.col("__up") != F.col("root")).alias("moved")), "near-roots")
        C.forget(parents.sparkSession, old)
    return now.select("id", "root")


def _stars(edges: DataFrame) -> bool:
    """Whether every component of the distinct ``edges`` (u > v) is a star about its smallest node: each u has one v, which is no u."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.x").agg(F.sum("e.low").alias("lows"), F.min("e.low").alias("least"))
    return nodes.agg(F.count_if((F.col("lows") > 1) | ((F.col("lows") > 0) & (F.col("least") == 0)))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every node of ``links`` (a, c): root is the smallest node of its connected component."""
    edges = C.written(links.where("a <> c").select(F.greatest("a", "c").alias("u"), F.least("a", "c").alias("v")).distinct(), "near-edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        old, edges = edges, C.written(small.select("e.u", "e.v").where("u <> v").distinct(), "near-edges")
        C.forget(links.sparkSession, old)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` whose ends are in different components, with these: a, c, ra, rc."""
    ra, rc = roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), roots.select(F.col("id").alias("c"), F.col("root").alias("rc"))
    return keyed(C.written(pairs.select("a", "c").join(ra, "a"), "near-fresh"), rc, ["c"]).where("ra <> rc").select("a", "c", "ra", "rc")


def _edges_to(rows: DataFrame, centre: str) -> DataFrame:
    """Distinct (a, c, n): the larger and the smaller of a member and its bucket's centre, and in how many buckets."""
    return rows.select(F.greatest("id", centre).alias("a"), F.least("id", centre).alias("c")).where("a <> c").groupBy("a", "c").agg(F.count("*").alias("n"))


def _mixed(rooted: DataFrame) -> DataFrame:
    """(b, top, most, total) of the buckets that hold several components: the largest one, its nodes and all nodes."""
    per = rooted.groupBy("b", "root").agg(F.count("*").alias("m"))
    return per.groupBy("b").agg(F.max(F.struct("m", "root")).alias("t"), F.sum("m").alias("total"), F.count("*").alias("k")).where("k > 1").select("b", F.col("t.root").alias("top"), F.col("t.m").alias("most"), "total")


def _own(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, u): how many shingles of each of ``ids`` are in no other one's set; ids with several sets have no row."""

    def make():
        def f(batch):
            for i, hashes in zip(batch.column("id"), batch.column("hashes")):
                h = np.frombuffer(hashes.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i.as_py())), pa.array(h)], ["id", "h"])

        return f

    some = sets.join(ids, "id", "left_semi")
    alone = some.groupBy("id").agg(F.count("*").alias("k")).where("k = 1").select("id")
    rows = C.map_batches(some, make, "id long, h long")
    return rows.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("k")).where("k = 1").groupBy("id").agg(F.count("*").alias("u")).join(alone, "id")


def _able(rooted: DataFrame, mixed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (b, id, root, top, total, n, u, bands, sketch) of mixed buckets, of the nodes that can be similar to another one at all.

    Shingles that no other node of these buckets has (u of n) are in no intersection and in every union: a node has at most
    (n - u) / n in common with any other, and a pair at most min(n - u) / max(n + the other's u).
    """
    rows = C.written(rooted.join(mixed.select("b", "top", "total"), "b"), "near-mixed")
    own = _own(sets, rows.select("id").distinct())
    able = nodes.select("id", "n", "bands", "sketch").join(own, "id", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    return C.written(rows.join(able.where(100 * (F.col("n") - F.col("u")) >= percent * F.col("n")), "id"), "near-able")


def _untried(rows: DataFrame, x: Column, y: Column, tried: DataFrame) -> DataFrame:
    """Distinct (a, c, ra, rc) of the rows' pairs of nodes x and y (structs of id and root) that were not tried: a is the larger id."""
    pairs = rows.select(F.greatest(x, y).alias("p"), F.least(x, y).alias("q")).select(F.col("p.id").alias("a"), F.col("q.id").alias("c"), F.col("p.root").alias("ra"), F.col("q.root").alias("rc"))
    return pairs.distinct().join(tried, ["a", "c"], "left_anti").select("a", "c", "ra", "rc")


def _rest(rows: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """(a, c, ra, rc) of all untried pairs of different components in buckets of at most SMALL nodes, that size, sketch and what each has
    of its own allow: at most SMALL for each row. A pair is made in its smallest common bucket only."""
    rows = rows.where(F.col("total") <= SMALL)
    x, y = rows.where("root <> top").alias("x"), rows.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.top")) | (F.col("x.id") < F.col("y.id")))
    sizes = 100 * F.least(F.col("x.n") - F.col("x.u"), F.col("y.n") - F.col("y.u")) >= percent * F.greatest(F.col("x.n") + F.col("y.u"), F.col("y.n") + F.col("x.u"))
    like = unlike(F.col("x.sketch"), F.col("y.sketch")) <= most_unlike(percent)
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.b")
    pairs = x.join(y, (F.col("x.b") == F.col("y.b")) & apart & sizes & like & once)
    return _untried(pairs, F.struct("x.id", "x.root"), F.struct("y.id", "y.root"), tried)


def _block_links(percent: int):
    """The nodes of a pair of blocks -> links (ra, rc) between their components, none that others imply. Pairs stay in the task."""
    most = most_unlike(percent)

    def f(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, root = table.column("block").to_numpy(), table.column("root").to_numpy()
        n, u, top = (table.column(c).to_numpy() for c in ("n", "u", "top"))
        sketch = np.array(table.column("sketch").to_pylist(), np.int64).view(np.uint64)
        sets = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        parent = {r: r for r in root.tolist()}

        def find(r):
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        links = []
        right = np.flatnonzero(block == j)
        for x in np.flatnonzero(block == i):
            y = right[right > x] if i == j else right
            y = y[(root[y] != root[x]) & ((root[x] != top[x]) | (root[y] != top[x]))]
            y = y[100 * np.minimum(n[y] - u[y], n[x] - u[x]) >= percent * np.maximum(n[y] + u[x], n[x] + u[y])]
            d = sketch[y] ^ sketch[x]
            y = y[np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1) <= most]
            for k in y.tolist():
                a, c = find(int(root[x])), find(int(root[k]))
                if a == c:
                    continue
                both = len(np.intersect1d(sets[x], sets[k], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[k]) - both):
                    parent[max(a, c)] = min(a, c)
                    links.append((max(a, c), min(a, c)))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "c": pa.array([c for _, c in links], pa.int64())})

    return f


def _large(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, c): links between components in buckets of over SMALL nodes.

    The buckets of one largest component are a cohort (near copies of one text share most of their buckets). Its nodes are cut by a
    hash into blocks of about GROUP and every two blocks meet in one task with their full sets, which gives links only.
    """
    cohort = rows.where(F.col("total") > SMALL).select("top", "id", "root", "n", "u", "sketch").distinct()
    cohort = C.written(cohort, "near-cohorts")
    k = cohort.groupBy("top").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("k"))
    blocks = cohort.join(k, "top").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = blocks.withColumn("o", other).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o", "k")
    some = sets.join(cohort.select("id").distinct(), "id", "left_semi")
    return dealt.join(some.hint("merge"), "id").groupBy("top", "i", "j").applyInArrow(_block_links(percent), "a long, c long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id; documents are linked at ``percent`` of Jaccard similarity."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = C.written(signatures(docs, shingle), "near-signatures")
    nodes = C.written(signed.where("k1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "near-nodes")
    buckets = nodes.select(F.explode("bands").alias("b"), "id")
    centres = buckets.groupBy("b").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("hi")
    shared = C.written(buckets.join(centres, "b"), "near-buckets")
    ids = shared.select("id").distinct()
    sets = C.written(full_sets(docs, ids, shingle), "near-sets")
    candidates = C.written(_edges_to(shared, "lo"), "near-candidates")

    # each node's most frequent centre makes a forest
    best = candidates.groupBy("a").agg(F.max(F.struct("n", -F.col("c"))).alias("x")).select("a", (-F.col("x").getField("col2")).alias("c"))
    parents = confirmed(sets, C.written(best, "near-best"), percent).groupBy("a").agg(F.min("c").alias("c"))
    roots = settled(ids.join(parents, ids.id == parents.a, "left").select("id", F.coalesce("c", "id").alias("root")))
    # then edges between its trees: the other candidates, and in buckets with several components those to a centre drawn anew;
    # a round without a link says nothing of the pairs it did not draw, so the rest is compared at last: as soon as it is small, or a
    # round did not halve it
    seed, tried, lefts, rest, found, size, before = 0, candidates.select("a", "c"), [], False, True, shared.count(), math.inf
    while not rest:
        seed += 1
        rooted = C.written(shared.select("b", "id").join(roots, "id"), "near-rooted")
        if seed > 1:
            mixed = C.written(_mixed(rooted), "near-mixed-buckets")
            pairs = mixed.agg(F.sum((F.col("total") - F.col("most")) * F.col("total"))).first()[0] or 0
            rest, before = not found or pairs <= REST * size or 2 * pairs > before, pairs
        large = None
        if rest:
            able = _able(rooted, mixed, nodes, sets, percent)
            large = _large(able, sets, percent)
            left = C.written(_rest(able, tried, percent), "near-left")
        else:
            drawn = F.min_by(F.struct("id", "root"), F.xxhash64("id", F.lit(seed))).alias("k")
            apart = rooted.groupBy("b").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), drawn).where("r0 < r1").select("b", F.col("k.id").alias("k"), F.col("k.root").alias("rk"))
            fresh = rooted.join(apart, "b").where("root <> rk")
            if seed == 1:
                left = _rooted(tried.unionByName(_edges_to(fresh, "k").select("a", "c")).distinct(), roots)
            else:
                left = _untried(fresh, F.struct("id", "root"), F.struct(F.col("k").alias("id"), F.col("rk").alias("root")), tried)
            left = C.written(left, "near-left")
        C.forget(docs.sparkSession, rooted)
        found = False
        if large is not None or not left.isEmpty():
            links = left.join(confirmed(sets, left.select("a", "c"), percent), ["a", "c"]).select(F.col("ra").alias("a"), F.col("rc").alias("c"))
            links = C.written(links if large is None else links.unionByName(large), "near-links")
            found = not links.isEmpty()
            if found:
                up = components(links).select(F.col("id").alias("root"), F.col("root").alias("__up"))
                roots = roots.join(up, "root", "left").select("id", F.coalesce("__up", "root").alias("root"))
                roots = roots if rest else C.written(roots, "near-roots")
            C.forget(docs.sparkSession, links)
            tried = tried.unionByName(left.select("a", "c"))
        lefts.append(left)

    found = C.written(nodes.select("k1", "k2", "id").join(roots, "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("component_id")), "near-found")
    C.forget(docs.sparkSession, shared, sets, candidates, *lefts)
    rows = signed.select("doc_id", "n_shingles", "k1", "k2")
    out = keyed(rows.where("k1 IS NOT NULL"), found, ["k1", "k2"], "left").unionByName(rows.where("k1 IS NULL").withColumn("component_id", F.lit(None).cast("long")))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.documents(spark, sf_dir), shingle=2)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: All pairs that share a shingle: for small tables only.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * k >= 80 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON r.id = u.a),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT doc_id, len(s) AS n_shingles, root AS component_id, doc_id = root AS kept FROM s JOIN c ON doc_id = id
"""
