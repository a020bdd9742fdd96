"""Scores of whole documents against plain Python, base columns against SQL, and odd tables."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import decontamination, kneser_ney, language_id, line_dedup, minhash_dedup, quality_rules, secret_scan, sentencepiece_codec, token_counts, toxicity

SF = "/root/testdata/sf0.001"
rng = random.Random(12)


def test_toxicity_is_the_mean_of_means(spark, docs_of):
    words = ["alpha", "beta", "gamma", "delta", "idiot", "scum,", "a", "é" * 70]
    texts = [None, "", *(" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(120)), "idiot " * 40_000]
    docs = docs_of(texts)
    marks = spark.createDataFrame([(i, int("idiot" in (t or ""))) for i, t in enumerate(texts, 1)] + [(5, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert model.buckets
    for r in toxicity.score(docs, model).collect():
        w = (texts[r.doc_id - 1] or "").lower().split()
        z = sum(sum(model.buckets.get(b, 0.0) for b in toxicity.subwords(x)) / len(toxicity.subwords(x)) for x in w) / max(1, len(w)) + model.bias
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_gradients_of_one_row_are_the_softmax_gradients():
    g = np.random.default_rng(5)
    x, e, w, b = g.random((7, 9)) * (g.random((7, 9)) < 0.5), g.normal(size=(9, 4)), g.normal(size=(2, 4)), g.normal(size=2)
    y = np.array([0, 1, 1, 0, 1, 0, 0])

    def loss(e, w, b):
        z = x @ e @ w.T + b
        return -(z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(7), y].sum()

    s = 1 / (1 + np.exp(-((x @ e @ (w[1] - w[0])) + b[1] - b[0]))) - y
    u = x.T @ s
    for a, got in ((e, np.outer(u, w[1] - w[0])), (w, np.outer([-1, 1], u @ e)), (b, s.sum() * np.array([-1, 1]))):
        for at in np.ndindex(a.shape):
            old, a[at] = a[at], a[at] + 1e-6
            up = loss(e, w, b)
            a[at] = old - 2e-6 + 1e-6
            low = loss(e, w, b)
            a[at] = old
            assert math.isclose((up - low) / 2e-6, got[at], rel_tol=1e-4, abs_tol=1e-5)


def test_language_is_the_largest_mean_marginal(spark, docs_of):
    parts = {"en": ["the", "ing", "of"], "de": ["der", "ung", "sch"]}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))
    texts = [make(lang, rng.randint(1, 60)) for _ in range(30) for lang in parts] + ["12 !", None, "the 9 der " + make("en", 9)]
    docs = docs_of(texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    crf = language_id.fit(docs.where("doc_id <= 60"))
    for r in language_id.predict(docs, crf).collect():
        words = [w for w in re.findall(r"[^\W\d_]+", (texts[r.doc_id - 1] or "").lower()) if any(map(str.isalpha, w))]
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        pots = []
        for w in words:
            rows, _ = language_id.features([w], crf.lexicon)
            pots.append(np.exp(crf.weights[rows].sum(0, dtype=float)))
        a = np.exp(crf.transitions)
        alpha, beta = [pots[0] / pots[0].sum()], [np.ones(2)]
        for p in pots[1:]:
            x = p * (alpha[-1] @ a)
            alpha.append(x / x.sum())
        for p in pots[:0:-1]:
            x = a @ (p * beta[-1])
            beta.append(x / x.sum())
        m = np.array([x * y / (x @ y) for x, y in zip(alpha, beta[::-1])]).mean(0)
        assert crf.langs[int(m.argmax())] == r.lang_pred and abs(m.max() - r.score) < 1e-4
    assert language_id.predict(docs.where("false"), crf).count() == 0


def test_many_languages_are_all_learned(spark):
    rows = [(i, " ".join([f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x"] * 12), f"l{i % 300:03d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkey = language_id.train
    try:  # the classes are what matters here, not fifty rounds over 300 of them
        language_id.train = lambda found: sorted({lang for lang, _ in found})
        assert len(language_id.fit(docs)) == 300
    finally:
        language_id.train = monkey


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    return con


def test_base_columns_of_the_language_model(spark, duck):
    ids = {i: zlib.crc32(str(i).encode()) % 10 == 0 for (i,) in duck.execute("SELECT doc_id FROM documents").fetchall()}
    duck.execute("CREATE OR REPLACE TEMP TABLE fold AS SELECT unnest(?) AS doc_id, unnest(?) AS held", [list(ids), list(ids.values())])
    want = duck.execute(r"""
    WITH t AS (SELECT doc_id, held, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10))) AS w FROM documents JOIN fold USING (doc_id)),
    c AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
    SELECT doc_id, count(*), count(c), (SELECT n FROM n)::BIGINT, sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / ((SELECT n FROM n) + 0.1::DOUBLE * ((SELECT v FROM n) + 1)))) FROM t LEFT JOIN c USING (w) GROUP BY doc_id""").fetchall()
    got = {r.doc_id: r for r in kneser_ney.query(spark, SF).collect()}
    assert len(got) == len(want)
    for i, tokens, known, train, base in want:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, train, ids[i]) and math.isclose(r.base_score, base, rel_tol=1e-9)


def test_bytes_and_folds(spark, duck):
    size = dict(duck.execute("SELECT doc_id, octet_length(encode(coalesce(text, ''))) FROM documents").fetchall())
    assert {r.doc_id: r.n_bytes for r in token_counts.query(spark, SF).collect()} == size
    for module in (language_id, toxicity):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in module.query(spark, SF).collect())


CLASH = ("id", "text_key", "h1", "b", "bands", "k1", "toxic", "kind", "bucket", "payload", "word", "__text", "__whole", "__id", "__key", "__keep", "component_id", "score", "lang_pred", "keep", "n_lines", "spans")


def test_every_operator_ignores_clashing_columns(spark, docs_of, tmp_path):
    texts = [None, "", "A line of text that is here.\nA line of text that is here.", "A line of text that is here.", "x " * 30_000 + "token=abcdefgh12"]
    plain = docs_of(texts, ids=[1, 2, 3, 4, 5])
    odd = plain
    for c in CLASH:
        odd = odd.withColumn(c, F.lit("?"))
    marks = spark.createDataFrame([(3, 1), (4, 0), (5, 0)], "doc_id long, toxic int").withColumn("text", F.lit("?"))
    bench = spark.createDataFrame([(1, "line of text that is here")], "item_id long, text string").withColumn("doc_id", F.lit(3))
    crf = language_id.fit(plain)
    operators = {
        "language": lambda d: language_id.predict(d, crf),
        "pieces": sentencepiece_codec.encode,
        "secrets": secret_scan.secret_spans,
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, marks)),
        "lines": lambda d: line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)),
        "near": minhash_dedup.near_duplicates,
        "tokens": token_counts.token_counts,
        "quality": quality_rules.quality,
        "leaks": lambda d: decontamination.with_leaks(d, bench),
        "model": lambda d: kneser_ney.scores(d, kneser_ney.fit(d)),
    }
    for name, operator in operators.items():
        a, b = (sorted(map(str, operator(d).collect())) for d in (plain, odd))
        assert a == b and len(a) == 5, name
        assert operator(odd.where("false")).count() == 0, name


def test_short_benchmark_items_stand_as_whole_words(spark, docs_of):
    bench = spark.createDataFrame([(1, "Ab c"), (2, "ab c"), (3, " "), (4, "zz"), (5, None)], "item_id long, text string")
    docs = docs_of(["so ab  C here", "cab c", "ab c", "zzz", "\nZZ", ""])
    got = {r.doc_id: sorted(x.item_id for x in r["__leaks"]) for r in decontamination.with_leaks(docs, bench).collect()}
    assert got == {1: [1, 2], 2: [], 3: [1, 2], 4: [], 5: [4], 6: []}
