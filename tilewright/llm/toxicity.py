"""Toxicity: a bag of subword embeddings averaged into a linear softmax, both trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (and of the whole word), hashed into BUCKETS places; a document is
the mean of its words; a linear softmax gives the two classes. Unseen misspellings share n-grams with known words. As every
step before the softmax is linear, a document is one weight for each bucket that it uses, and prediction needs one number a bucket:
the difference of the two logits.

Learned from a bounded sample: about SAMPLE labelled documents of each class, chosen by a hash of their ids, each class weighing in
the loss what it weighs among all labels. The executors turn the whole sampled texts into bucket weights; only buckets that
MIN_USES sampled documents use have an embedding, so the driver gets at most that many numbers a document and no text. Training
takes STEPS steps of BATCH documents at every size. The broadcast model is one number for each bucket in use, of BUCKETS at
most. Prediction is one pass without a shuffle; memory is one text's words and a cache of CACHE words.

Results: an empty or null text gets the bias alone; without labels the score is 0; conflicting labels of one id count as 1; of
rows that repeat an id the least text is learned from; null labels and null ids are not learned from; repeated rows are scored
each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C

SAMPLE = 3_000
BUCKETS = 1 << 21
DIM = 8
NGRAMS = (3, 4, 5)
STEPS, BATCH = 600, 128
MIN_USES = 20  # buckets that fewer sampled documents use have no embedding
DECAY = 5e-4  # of the embeddings, a step
CACHE = 400_000
THRESHOLD = 0.3
_EDGES = ".,;:!?\"'()[]{}|…«»“”„"


def subwords(token: str) -> list[int]:
    """Buckets of a lower-case token's n-grams and of the token itself."""
    w = f"<{token.strip(_EDGES) or token}>".encode("utf-8", "surrogatepass")
    crc, n = zlib.crc32, len(w)
    return [crc(w) % BUCKETS, *(crc(w[i : i + k]) % BUCKETS for k in NGRAMS for i in range(n - k + 1))]


class Model:
    """The logit's part of each bucket in use, and the bias."""

    def __init__(self, buckets: dict[int, float], bias: float):
        self.buckets, self.bias = buckets, float(bias)


class Scorer(dict):
    """token -> its part of the logit."""

    def __init__(self, model: Model):
        self.bias, self.value = model.bias, model.buckets.get

    def __missing__(self, token: str) -> float:
        b = subwords(token)
        x = sum([self.value(i, 0.0) for i in b]) / len(b)
        if len(token) <= 64:
            self[token] = x
        return x

    def score(self, text: str) -> float:
        if len(self) > CACHE:
            self.clear()
        words = text.lower().split()
        z = self.bias + (math.fsum(map(self.__getitem__, words)) / len(words) if words else 0.0)
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


class Weights(dict):
    """token -> its buckets; ``of``: a text's buckets, sorted, with the weight that the mean of means gives each."""

    def __missing__(self, token: str) -> np.ndarray:
        x = np.array(subwords(token), np.int64)
        if len(token) <= 64:
            self[token] = x
        return x

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHE:
            self.clear()
        count: dict[str, int] = {}
        for w in text.lower().split():
            count[w] = count.get(w, 0) + 1
        if not count:
            return np.empty(0, np.int64), np.empty(0)
        parts = [self[w] for w in count]
        size = np.array([len(p) for p in parts])
        n = np.array(list(count.values()))
        flat, back = np.unique(np.concatenate(parts), return_inverse=True)
        return flat, np.bincount(back, np.repeat(n / size, size)) / n.sum()


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], share: float, common: np.ndarray, seed: int = 11, rate: float = 1.5) -> Model:
    """``docs``: places in ``common``, the buckets with an embedding, and their weights; ``share``: of label 1 among all labelled
    documents."""
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return Model({}, -1000.0 if not len(y) or y.max() == 0 else 1000.0)
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    e = rng.uniform(-0.1, 0.1, (len(common), DIM)).astype(np.float32)
    w = rng.uniform(-0.5, 0.5, (2, DIM)).astype(np.float32)
    b = np.array([0.0, math.log(share / (1 - share))])
    he, hw, hb = np.full(len(common), 1e-10, np.float32), np.full_like(w, 1e-8), np.full(2, 1e-8)
    order = np.empty(0, np.int64)
    for k in range(STEPS):
        step = rate * (1 - k / STEPS)
        while len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(y))])
        batch, order = order[:BATCH], order[BATCH:]
        ids = np.concatenate([docs[i][0] for i in batch])
        part = np.concatenate([docs[i][1] for i in batch])
        of = np.repeat(np.arange(BATCH), [len(docs[i][0]) for i in batch])
        # with two classes the gradients of the logits are s and -s, so those of the embeddings are u times the difference of w
        apart = w[1] - w[0]
        z = np.bincount(of, (e @ apart)[ids] * part, BATCH) + b[1] - b[0]
        s = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[batch]) * weight[batch] / BATCH
        u = np.bincount(ids, s[of] * part, len(common)).astype(np.float32)
        gw, gb = np.outer([-1, 1], u @ e), s.sum() * np.array([-1, 1])
        he += u * u * (apart * apart).mean()
        hw += gw * gw
        hb += gb * gb
        e *= 1 - DECAY
        e -= (step * u / np.sqrt(he))[:, None] * apart
        w -= (step * gw / np.sqrt(hw)).astype(np.float32)
        b -= step * gb / np.sqrt(hb)
    return Model(dict(zip(common.tolist(), (e @ (w[1] - w[0])).tolist())), b[1] - b[0])


def _used():
    """Texts -> buckets in use, with the number of documents."""

    def run(batches):
        weights, uses = Weights(), {}
        for batch in batches:
            for text in C.texts(batch):
                for b in weights.of(text)[0].tolist():
                    uses[b] = uses.get(b, 0) + 1
        if uses:
            yield pa.RecordBatch.from_arrays([pa.array(uses.keys(), pa.int64()), pa.array(uses.values(), pa.int64())], ["bucket", "n"])

    return run


def _vectors(shared):
    """Texts -> places in the common buckets and their weights."""

    def make():
        weights, common = Weights(), shared.value

        def f(batch):
            at, part = [], []
            for text in C.texts(batch):
                b, x = weights.of(text)
                place = np.searchsorted(common, b)
                place[place == len(common)] = 0
                ok = common[place] == b if len(common) else np.zeros(len(b), bool)
                at.append(place[ok].astype("<i4").tobytes())
                part.append(x[ok].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(at, pa.binary()), pa.array(part, pa.binary())], ["doc_id", "toxic", "at", "part"])

        return f

    return make


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of ``labels`` (doc_id, toxic) and the texts of ``docs``."""
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(SAMPLE / max(1, counts.get(1, 0)))).otherwise(F.lit(SAMPLE / max(1, counts.get(0, 0))))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))  # about 2 * SAMPLE distinct ids, whatever the table's size
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = C.written(rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).repartition(32, "doc_id"), "toxicity-sample")
    uses = sample.select("text").mapInArrow(_used(), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_USES)
    common = np.array(sorted(r.bucket for r in uses.select("bucket").collect()), np.int64)  # of BUCKETS at most
    shared = docs.sparkSession.sparkContext.broadcast(common)
    found = sorted((r.doc_id, r.toxic, r.at, r.part) for r in C.map_batches(sample, _vectors(shared), "doc_id long, toxic int, at binary, part binary").toLocalIterator())
    vectors = [(np.frombuffer(at, "<i4"), np.frombuffer(part, "<f4")) for _, _, at, part in found]
    return train(vectors, [t for _, t, _, _ in found], min(0.999, max(0.001, counts.get(1, 0) / max(1, sum(counts.values())))), common)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def f(batch):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([scorer.score(x) for x in C.texts(batch)], pa.float64())], ["doc_id", "score"])

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return C.map_batches(rows, make, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(C.fold("doc_id", 4) != 2)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", C.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
