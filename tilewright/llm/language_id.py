"""Language identification: a linear-chain conditional random field labels each word, also in code-switched text.

A word's features are its affixes, its character n-grams, itself, and its presence in the lexicon of frequent words of each
language, hashed into BUCKETS rows of weights; one matrix holds the learned transitions between neighbouring words.
Training maximises the conditional likelihood on sequences spliced from windows of differently labelled texts, so switches
are seen. Forward-backward over the whole text gives every word's marginals; a document's language is the one with the
largest mean marginal, which is also the score.

Learned from a bounded sample: of each language that a label names about SAMPLE_DOCS rows, chosen by a hash, at most WINDOWS windows
of WINDOW words of at most WORD letters from each. The model is broadcast: (BUCKETS + languages) * languages weights of 4 bytes and
LEXICON words a language.
Prediction is one pass without a shuffle; memory is bounded by BLOCK words or one document.

Results: ``und`` with score 0 for a null text, one without letters, or without anything to learn from; ties go to the first
language in code-point order; rows with a null id are predicted, but not learned from; repeated rows are predicted each and equal
windows learned from once; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C

SAMPLE_DOCS = 400
WINDOWS, WINDOW, WORD = 3, 50, 64
LEXICON = 500
BUCKETS = 1 << 16
BLOCK = 300_000
CACHE = 250_000

words_in = re.compile(r"[^\W\d_]+").findall


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(row of the weights, number of the word) of every feature: all 2- and 3-grams of ``<word>``, its affixes as the 4- and
    5-grams at its ends, the word itself, and the lexicons it is in (a row for each language after the BUCKETS)."""
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    of = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    rows, owner, hashed = [], [], c
    for k in (2, 3, 4, 5):
        hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[k - 1 :]
        if k < 4:
            at = np.flatnonzero(of[: len(hashed)] == of[k - 1 :])
        else:
            long = size >= k
            at = np.concatenate([start[long], (start + size - k)[long & (size > k)]])
        rows.append(hashed[at] * np.uint64(2 * k + 1))
        owner.append(of[at])
    rows.append(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)))
    owner.append(np.arange(len(words)))
    flat = np.concatenate(rows) * np.uint64(0xD6E8FEB86659FD93)
    known = [(BUCKETS + k, i) for i, w in enumerate(words) for k in lexicon.get(w, ())]
    return (
        np.concatenate([((flat >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64), np.array([k for k, _ in known], np.int64)]),
        np.concatenate([*owner, np.array([i for _, i in known], np.int64)]),
    )


def _sums(weights: np.ndarray, flat: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(of, weights[flat, k], n) for k in range(weights.shape[1])], 1)


def packed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences in descending length, one after another: the time-major order of their items, and how many at each step."""
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.argsort(at, kind="stable"), np.bincount(at)


def forward_backward(e: np.ndarray, sizes: np.ndarray, a: np.ndarray, pairs: bool = False):
    """Marginals of time-major potentials ``e``; with ``pairs`` also expected transitions and the log likelihood's normaliser."""
    off = np.concatenate([[0], np.cumsum(sizes)])
    alpha, scale = np.empty_like(e), np.empty(len(e), e.dtype)
    for t, n in enumerate(sizes):
        x = e[off[t] : off[t] + n]
        if t:
            x = x * (alpha[off[t - 1] : off[t - 1] + n] @ a)
        scale[off[t] : off[t] + n] = z = x.sum(1)
        alpha[off[t] : off[t] + n] = x / z[:, None]
    xi = np.zeros_like(a)
    beta = np.ones((sizes[-1], a.shape[0]), e.dtype)
    at = a.T.copy()
    for t in range(len(sizes) - 1, 0, -1):
        here = slice(off[t], off[t] + sizes[t])
        m = e[here] * beta / scale[here, None]
        alpha[here] *= beta
        before = alpha[off[t - 1] : off[t - 1] + sizes[t]]
        if pairs:
            xi += before.T @ m
        beta = np.ones((sizes[t - 1], a.shape[0]), e.dtype)
        beta[: sizes[t]] = m @ at
    alpha[: sizes[0]] *= beta
    return (alpha, xi * a, np.log(scale).sum()) if pairs else alpha


class Crf:
    def __init__(self, langs: list[str], lexicon: dict[str, tuple[int, ...]], weights: np.ndarray, transitions: np.ndarray):
        self.langs, self.lexicon, self.weights, self.transitions = langs, lexicon, weights, transitions

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """word -> row of ``table`` with its potentials, or -1 for a word without a letter."""

    def __init__(self, crf: Crf):
        self.crf, self.a = crf, np.exp(crf.transitions - crf.transitions.max(initial=0.0)).astype(np.float32)
        self.columns = np.asfortranarray(crf.weights)
        self.table = np.empty((0, len(crf.langs)), np.float32)

    def learn(self, words: set[str]) -> None:
        """Add the potentials of words that are new, all at once."""
        new = [w for w in words if w not in self]
        good = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
        if len(good) < len(new):
            self.update(dict.fromkeys(new, -1))
        if good:
            self.update(zip(good, range(len(self.table), len(self.table) + len(good))))
            self.table = np.concatenate([self.table, _sums(self.columns, *features(good, self.crf.lexicon), len(good)).astype(np.float32)])

    def ids(self, words: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return ids[ids >= 0] if len(ids) and ids.min() < 0 else ids

    def means(self, many: list[np.ndarray]) -> np.ndarray:
        """Mean marginals of each of the (non-empty) texts."""
        order = sorted(range(len(many)), key=lambda i: -len(many[i]))
        lengths = np.array([len(many[i]) for i in order])
        perm, sizes = packed(lengths)
        s = self.table[np.concatenate([many[i] for i in order])[perm]]
        s -= s.max(1, keepdims=True)
        gamma = forward_backward(np.exp(np.maximum(s, -60.0)), sizes, self.a)
        total = np.zeros((len(many), gamma.shape[1]))
        off = 0
        for n in sizes:
            total[:n] += gamma[off : off + n]
            off += n
        out = np.empty_like(total)
        out[order] = total / total.sum(1, keepdims=True)
        return out

    def word_marginals(self, text: str) -> list[tuple[str, np.ndarray]]:
        """The words of one text with their marginals."""
        words = words_in(text.lower())
        self.learn(set(words))
        words = [w for w in words if self[w] >= 0]
        if not words:
            return []
        s = self.table[[self[w] for w in words]]
        g = forward_backward(np.exp(np.maximum(s - s.max(1, keepdims=True), -60.0)), np.ones(len(words), int), self.a)
        return list(zip(words, g / g.sum(1, keepdims=True)))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.crf.langs:
            return out
        for block in self._blocks(texts):
            if len(self) > CACHE:
                self.clear()
                self.table = self.table[:0]
            self.learn(set().union(*(w for _, w in block)))
            found = [(i, x) for i, w in block if len(x := self.ids(w))]
            if found:
                for (i, _), m in zip(found, self.means([x for _, x in found])):
                    k = int(m.argmax())
                    out[i] = (self.crf.langs[k], float(m[k]))
        return out

    def _blocks(self, texts: list[str]):
        block, n = [], 0
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):  # texts of one length share the steps
            words = words_in(texts[i].lower())
            if n and n + len(words) > BLOCK:
                yield block
                block, n = [], 0
            block.append((i, words))
            n += len(words)
        yield block


def train(rows: list[tuple[str, list[str]]], rounds: int = 50, rate: float = 0.3, seed: int = 7) -> Crf:
    """``rows``: language and words of each window."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Crf([], {}, np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    rng, lab = np.random.default_rng(seed), {x: i for i, x in enumerate(langs)}
    counts = [Counter() for _ in langs]
    for lang, words in rows:
        counts[lab[lang]].update(words)
    lexicon: dict[str, tuple[int, ...]] = {}
    for k, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = (*lexicon.get(w, ()), k)
    # each language weighs the same; half of the sequences switch inside
    by_lang = [[words for lang, words in rows if lab[lang] == k] for k in range(len(langs))]
    sequences = []
    for _ in range(max(map(len, by_lang)) * len(langs)):
        seq, parts = [], int(rng.choice([1, 1, 2, 3]))
        for _ in range(parts):
            k = int(rng.integers(len(langs)))
            words = by_lang[k][int(rng.integers(len(by_lang[k])))]
            size = max(1, len(words) // parts)
            at = int(rng.integers(len(words) - size + 1))
            seq += [(w, k) for w in words[at : at + size]]
        sequences.append(seq)
    sequences.sort(key=len, reverse=True)
    vocab: dict[str, int] = {}
    ids = np.array([vocab.setdefault(w, len(vocab)) for s in sequences for w, _ in s])
    gold = np.array([k for s in sequences for _, k in s])
    perm, sizes = packed(np.array([len(s) for s in sequences]))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sequences])[:-1]])
    seen = np.zeros((len(langs), len(langs)))
    inner = np.setdiff1d(np.arange(1, len(gold)), first)
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    ids, gold = ids[perm], gold[perm]
    flat, of = features(list(vocab), lexicon)
    w, a = np.zeros((BUCKETS + len(langs), len(langs))), np.zeros((len(langs), len(langs)))
    hw, ha, n = np.full_like(w, 1e-8), np.full_like(a, 1e-8), len(gold)
    for _ in range(rounds):
        s = _sums(w, flat, of, len(vocab))[ids]
        ea = np.exp(a - a.max())
        gamma, xi, _ = forward_backward(np.exp(np.maximum(s - s.max(1, keepdims=True), -60.0)), sizes, ea, pairs=True)
        gamma[np.arange(n), gold] -= 1
        ga = (xi - seen) / n + 1e-5 * a
        gv = np.stack([np.bincount(ids, gamma[:, k], len(vocab)) for k in range(len(langs))], 1)[of]
        gw = np.stack([np.bincount(flat, gv[:, k], len(w)) for k in range(len(langs))], 1) / n + 1e-7 * w
        hw += gw * gw
        ha += ga * ga
        w -= rate * gw / np.sqrt(hw)
        a -= rate * ga / np.sqrt(ha)
    return Crf(langs, lexicon, w.astype(np.float32), a)


def _windows(batch: pa.RecordBatch):
    """At most WINDOWS windows of each text, placed by its content."""
    out = []
    for lang, text in zip(batch.column("lang").to_pylist(), C.texts(batch)):
        words = [w for w in words_in(text.lower()) if any(map(str.isalpha, w)) and len(w) <= WORD]
        spots = max(1, len(words) // WINDOW)
        whole = text.encode("utf-8", "surrogatepass")
        for k in sorted({zlib.crc32(whole, i) % spots for i in range(WINDOWS)}):
            if part := words[k * WINDOW : (k + 1) * WINDOW]:
                out.append((lang, part))
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.list_(pa.string()))], ["lang", "words"])


def fit(labelled: DataFrame) -> Crf:
    """Train on a bounded sample of rows (doc_id, text, lang)."""
    counts = labelled.groupBy("lang").count().orderBy("lang").collect()  # one row a language
    if not counts:
        return train([])
    share = F.element_at(F.create_map(*(x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, SAMPLE_DOCS / r["count"]))))), F.col("lang"))
    rows = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))
    found = C.map_batches(rows.select("lang", "text"), lambda: _windows, "lang string, words array<string>").distinct().collect()  # WINDOWS for each row of the sample at most
    return train(sorted((r.lang, list(r.words)) for r in found))


def predict(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def make():
        scorer = model.value.scorer()

        def f(batch):
            found = scorer.predict(C.texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return C.map_batches(rows, make, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    known = docs.select("doc_id", "text", "lang").where((C.fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return predict(docs, fit(known)).select("doc_id", C.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
