"""The pipeline against a plain version, stage by stage."""

import random
import re

import corpus_pipeline as P
from tilewright.llm import decontamination, quality_rules
from tilewright.llm.sentencepiece_codec import Codec
from tilewright.llm.token_counts import model_path

rng = random.Random(6)


def prose(n):
    words = ["".join(rng.choice(["an", "er", "th", "ou", "st", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


ITEM = prose(24).replace("\n", " ")


def rows():
    clean = [prose(120) for _ in range(8)]
    near = clean[0].split("\n")
    near = "\n".join(line.replace(" ", "  ", 1) for line in near)  # other lines, the same words
    texts = [*clean, clean[1], near, clean[2] + "\n" + ITEM.upper() + "\n" + prose(120), prose(20), "a | b | c |\n" * 60, None, "", "go go go " * 80, clean[3] + "\nAll rights reserved."]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, clean[3], "en", "s", 0)]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs):
    docs = [(i, quality_rules.judge(t or "")) for i, t in docs]
    docs = [(i, j[8]) for i, j in docs if j[7]]
    yield docs
    owner, out = {}, []
    key = lambda line: line.strip(" \t\n\v\f\r").lower()
    for i, t in sorted(docs):
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                owner.setdefault(key(line), i)
    for i, t in docs:
        kept = [line for line in t.split("\n") if len(key(line)) < 10 or owner[key(line)] == i]
        if len(kept) == len(t.split("\n")) or any(len(key(line)) >= 10 for line in kept):
            out.append((i, "\n".join(kept)))
    docs = out
    yield docs
    gone = {j for i, a in docs for j, b in docs if i < j and shingles(a) and 100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b))}
    docs = [(i, t) for i, t in docs if i not in gone]
    yield docs
    index = decontamination.Index([(1, ITEM)])
    docs = [(i, t) for i, t in docs if not index.search([decontamination.normal(t)])[0]]
    yield docs


def test_stages(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS score", "'x' AS kept", "2 AS n_lines")  # extra columns
    want = plain([(i, t) for i, t, *_ in data])
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(next(want))
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert {1, 2, 3, 4, 5, 6, 7} <= set(kept) and not {8, 10, 11, 12, 13, 14, 15} & set(kept)
    codec = Codec(model_path())
    for r in P.STAGES[-1][1](spark, docs, str(tmp_path)).collect():
        assert r.lossless and codec.decode(r.piece_ids) == kept[r.doc_id]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
