"""The counted model against a plain one."""

import math
from collections import Counter, defaultdict

import numpy as np

from tilewright.llm import kneser_ney as K

TEXTS = ["a b a b c", "A b\tc a b", "the cat the dog", "the cat sat", None, "", "a b a b c", "x " * 300, "b c d e f g h the the the"]


def plain(train, texts):
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    uni, bi = Counter(), Counter()
    for t in train:
        w = words(t)
        uni.update(w)
        bi.update(zip(["^", *w], w))
    n = [sum(1 for v in bi.values() if v == k) for k in (1, 2, 3, 4)]
    cont = Counter(b for _, b in bi)
    m = [sum(1 for v in cont.values() if v == k) for k in (1, 2, 3, 4)]
    d, dw = K.discounts(n), K.discounts(m)
    follow = defaultdict(Counter)
    for (a, b), c in bi.items():
        follow[a][b] = c
    spare1 = sum(dw[min(c, 3)] for c in cont.values())

    def low(b):
        return (max(cont[b] - dw[min(cont[b], 3)], 0) + spare1 / (len(uni) + 1)) / len(bi)

    def p(a, b):
        f = follow.get(a)
        if not f:
            return low(b)
        total = sum(f.values())
        return (max(f[b] - d[min(f[b], 3)], 0) + sum(d[min(c, 3)] for c in f.values()) * low(b)) / total

    out = []
    for t in texts:
        w = words(t)
        base = sum(math.log10((uni[x] + 0.1) / (sum(uni.values()) + 0.1 * (len(uni) + 1))) for x in w)
        out.append((len(w), sum(uni[x] > 0 for x in w), base, sum(math.log10(p(a, b)) for a, b in zip(["^", *w], w))))
    return out, p, uni


def test_scores_equal_a_plain_model(docs_of):
    docs = docs_of([*TEXTS, "unseen words only"])
    model = K.fit(docs.where("doc_id < 10"))
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in K.scores(docs, model).collect()}
    want, p, uni = plain(TEXTS, [*TEXTS, "unseen words only"])
    assert model.tokens == sum(uni.values()) and model.types == len(uni)
    for i, w in enumerate(want, 1):
        assert got[i][:2] == w[:2]
        assert np.allclose(got[i][2:], w[2:], rtol=1e-9)
    for a in ("a", "the", "^"):  # probabilities of the known words and the unknown one sum to 1
        assert abs(sum(p(a, b) for b in [*uni, "?"]) - 1) < 1e-9


def test_empty_tables_and_nothing_to_learn(docs_of):
    docs = docs_of(TEXTS)
    model = K.fit(docs.where("false"))
    assert all(r.score == 0 and r.base_score == 0 for r in K.scores(docs, model).collect())
    assert K.scores(docs.where("false"), model).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 48, 1000).astype(np.uint64)
    for top in (0, 200, 1 << 15, 1 << 31, 1 << 40):
        n = rng.integers(0, top + 1, 50)
        assert (K._unthin(K._thin(n)) == n).all()
    assert (K._unsix(K._six(a)) == a).all()
    assert K._split(K._join(b"a", b"", b"xyz")) == [b"a", b"", b"xyz"]


def test_parts_of_many_buckets_give_the_same_scores(docs_of, monkeypatch):
    docs = docs_of([*TEXTS, "a b unseen"])
    want = {r.doc_id: r.score for r in K.scores(docs, K.fit(docs)).collect()}
    monkeypatch.setattr(K, "BUCKET_BYTES", 1)  # 2 ** 10 buckets, two of them a file
    model = K.fit(docs)
    assert model.shift > 0
    got = {r.doc_id: r.score for r in K.scores(docs, model).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in want)


def test_a_very_long_text(docs_of):
    text = "a b c d " * 200_000
    docs = docs_of([text, "a b c d"])
    got = {r.doc_id: r for r in K.scores(docs, K.fit(docs)).collect()}
    assert got[1].n_tokens == 800_001 and got[1].n_known == 800_001 and got[1].score < 0
