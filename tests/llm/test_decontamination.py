"""Filter and alignment against a plain search."""

import random

from tilewright.llm import decontamination as D


def plain(text, item):
    """Least edits between the item and any part of the text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        k, i = rng.choice("ids"), rng.randrange(len(text))
        if k == "i":
            text.insert(i, rng.choice("xyzé"))
        elif k == "d":
            del text[i]
        else:
            text[i] = rng.choice("xyzé")
    return "".join(text)


def test_finds_what_a_plain_search_finds():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, D.normal(prose(rng.choice([3, 8, 20, 40])))) for i in range(12)]
    items = [(i, t) for i, t in items if len(t) >= D.Q]
    texts = []
    for _ in range(60):
        i, t = rng.choice(items)
        texts.append(D.normal(prose(rng.randint(0, 12)) + " " + edited(rng, t, rng.randint(0, max(1, int(len(t) * 0.14)))) + " " + prose(rng.randint(0, 12))))
    texts += ["", "ab", items[0][1], items[1][1] + " " + items[1][1]]
    got = D.Index(items).search(texts)
    want = [sorted((i, d) for i, t in items if (d := plain(x, t)) <= D.budget(len(t))) for x in texts]
    assert [[i for i, _ in x] for x in got] == [[i for i, _ in x] for x in want]
    assert sum(map(len, want)) > 40
    assert all(a == b for x, y in zip(got, want) for (_, a), (_, b) in zip(x, y))


def test_odd_rows_and_blocks(spark, docs_of, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    docs = docs_of([None, "", "x", f"so {item.upper()}\n end", "a" * 200_000 + item, f"so {item} end", f"so {item} end"], ids=[1, None, 3, 4, 5, 6, 6])
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "short", 0), (None, item, 0), (5, item, 0)], "item_id long, text string, doc_id int")
    for size in (D.BLOCK_ITEMS, 80):
        monkeypatch.setattr(D, "BLOCK_ITEMS", size)
        rows = D.with_leaks(docs, bench).collect()
        got = sorted(((r.doc_id or 0), sorted(x.item_id for x in r["__leaks"])) for r in rows)
        assert got == [(0, []), (1, []), (3, []), (4, [1, 5]), (5, [1, 5]), (6, [1, 5]), (6, [1, 5])]
    assert D.with_leaks(docs, bench.where("false")).where("size(__leaks) > 0").count() == 0
    assert D.with_leaks(docs.where("false"), bench).count() == 0
