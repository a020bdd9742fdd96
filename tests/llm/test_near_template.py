"""Pairs of a template family whose other members are just below the bound are all linked."""

from tilewright.llm import minhash_dedup


def test_pairs_of_a_template_family(docs_of):
    # 350 common words and 50 own ones: similarity 350 / 450; neighbours 2k, 2k + 1 (k < 50) share 7 more: 357 / 443
    common = [f"t{j}" for j in range(350)]
    own = lambda i: [f"p{i // 2}_{j}" if i < 100 and j < 7 else f"d{i}_{j}" for j in range(50)]
    got = minhash_dedup.near_duplicates(docs_of([" ".join(common + own(i)) for i in range(300)]), shingle=1).collect()
    assert {r.doc_id: r.component_id for r in got} == {i + 1: i - i % 2 + 1 if i < 100 else i + 1 for i in range(300)}


def test_hot_keys_lose_no_rows(spark, docs_of, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LEAST_HOT", 2)
    base = " ".join(f"w{j}" for j in range(60))
    texts = [base] * 9 + [f"{base} x{i}" for i in range(9)] + [None] * 4 + ["only rows without an id hold this"] * 5 + ["alone"]
    ids = [*range(22), *[None] * 5, 22]
    got = minhash_dedup.near_duplicates(docs_of(texts, ids=ids)).collect()
    assert len(got) == 28
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(i, 0 if i < 18 else i) for i in range(23)]
    assert all(r.component_id is None for r in got if r.doc_id is None)
    rows, table = spark.createDataFrame([(k % 3, k) for k in range(20)] + [(9, 99)] * 4, "k long, v long"), spark.createDataFrame([(0, "a"), (1, "b")], "k long, w string")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(table, ["k"], how).collect()))
        assert sorted(map(str, minhash_dedup.keyed(rows, table, ["k"], how).select("k", "v", "w").collect())) == want


def test_components_of_stars_and_chains(spark, monkeypatch):
    """Stars took two rounds of steps, each of them a table written, to show that nothing moved."""
    tags, written = [], minhash_dedup.C.written
    monkeypatch.setattr(minhash_dedup.C, "written", lambda df, tag: (tags.append(tag), written(df, tag))[1])
    roots = lambda links: dict(map(tuple, minhash_dedup.components(spark.createDataFrame(links, "a long, c long")).collect()))
    assert roots([(i, i % 3) for i in range(3, 30)] + [(4, 1)]) == {i: i % 3 for i in range(30)}
    assert tags == ["near-edges"]
    assert roots([(i + 1, i) for i in range(40, 60)] + [(9, 7), (9, 8), (8, 3), (5, 5)]) == {i: 40 for i in range(40, 61)} | {i: 3 for i in (3, 7, 8, 9)}
    assert len(tags) > 2


def test_centres_of_many_members(spark, monkeypatch):
    """Members of a centre are dealt out by a share known to every task; no table of shares is joined."""
    monkeypatch.setattr(minhash_dedup, "GROUP", 4)
    tags, written = [], minhash_dedup.C.written
    monkeypatch.setattr(minhash_dedup.C, "written", lambda df, tag: (tags.append(tag), written(df, tag))[1])
    sets = spark.createDataFrame([(i, minhash_dedup.np.arange(10 + (i % 5 == 4) * 9, dtype="uint64").tobytes()) for i in range(60)], "id long, hashes binary")
    pairs = spark.createDataFrame([(i, i % 2) for i in range(2, 50)] + [(i, 50) for i in range(51, 54)], "a long, c long")
    got = sorted(map(tuple, minhash_dedup.confirmed(sets, pairs, 80).collect()))
    assert got == sorted((r.a, r.c) for r in pairs.collect() if r.a % 5 != 4) and not tags
