"""Exact round trips, and path frequencies against all paths."""

import math
import random
from collections import Counter

import numpy as np

from tilewright.llm import sentencepiece_codec as S
from tilewright.llm.token_counts import model_path

CODEC = S.Codec(model_path())


def all_paths(p, text):
    """(ids, weight) of every segmentation of one unit."""
    pieces = {b.decode("utf-8", "ignore"): i for i, b in enumerate(p.bytes_of) if b and not (i in set(p.byte_id.tolist()))}
    if not text:
        return [((), 1.0)]
    out = []
    for k in range(1, len(text) + 1):
        if text[:k] in pieces:
            i = pieces[text[:k]]
            out += [((i, *rest), w * math.exp(p.log_weight[i])) for rest, w in all_paths(p, text[k:])]
    if text[0] not in pieces:
        raw = text[0].encode()
        out += [((*(int(p.byte_id[b]) for b in raw), *rest), w * math.exp(p.byte_weight * len(raw))) for rest, w in all_paths(p, text[1:])]
    return out


def test_sampled_paths_follow_their_weights():
    n = 20_000
    paths = dict(all_paths(CODEC.pieces, " théx"))
    ids, many = CODEC.encode(["théx"] * n, np.arange(n, dtype=np.uint64))
    seen = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(many)[:-1]))
    total = sum(paths.values())
    assert set(seen) <= set(paths)
    for path, w in paths.items():
        assert abs(seen[path] / n - w / total) < 4 * math.sqrt(w / total / n) + 2e-4


def test_round_trip_and_same_pieces_in_any_batch():
    rng = random.Random(2)
    texts = ["", " ", "  a", "a  ", "\n", "▁x ▁", "\0", "日本語 emoji 🙂", "a" * 3000, "<s> </s> <0x41>", "\r\n\t"]
    texts += ["".join(rng.choices(" \nabcthé▁🙂0", k=rng.randint(0, 40))) for _ in range(500)]
    keys = np.arange(len(texts), dtype=np.uint64)
    ids, many = CODEC.encode(texts, keys)
    parts = [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])]
    assert [CODEC.decode(p) for p in parts] == texts
    for i in range(0, len(texts), 37):
        alone, _ = CODEC.encode([texts[i]], keys[i : i + 1])
        assert alone.tolist() == parts[i]
    other, _ = CODEC.encode(texts, keys + np.uint64(1))
    assert other.tolist() != ids.tolist()


def test_a_cold_codec_gives_the_pieces_of_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.piece_ids for r in S.encode(docs).collect()}
    again = {r.doc_id: r.piece_ids for r in S.encode(docs.repartition(7, "n_chars")).collect()}
    assert again == want
    keys = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 0) AS k").collect()}
    pieces = S.Pieces(model_path())
    for r in docs.collect():
        cold = S.Codec.__new__(S.Codec)
        cold.pieces, cold.numbers, cold.kept = pieces, S._Numbers(), []
        ids, _ = cold.encode([r.text or ""], np.array([keys[r.doc_id]], np.int64).view(np.uint64))
        assert ids.tolist() == want[r.doc_id]


def test_very_long_text_and_unit():
    texts = ["ab c" * 300_000, "x" * 20_000, "\n" * 5_000]
    ids, many = CODEC.encode(texts, np.arange(3, dtype=np.uint64))
    assert [CODEC.decode(x.tolist()) for x in np.split(ids, np.cumsum(many)[:-1])] == texts


def test_tables(docs_of):
    docs = docs_of([None, "", "ab cd", "ab cd", "ab cd"], ids=[1, 2, 3, 3, None])
    rows = S.encode(docs).collect()
    assert all(r.lossless for r in rows) and [r.n_pieces for r in rows][:2] == [0, 0]
    assert rows[2] == rows[3]
    back = S.decode(S.encode(docs)).collect()
    assert [r.text for r in back] == ["", "", "ab cd", "ab cd", "ab cd"]
    assert S.encode(docs.where("false")).count() == 0
