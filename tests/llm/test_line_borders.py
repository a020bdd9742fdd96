"""A line that crosses the borders of range partitions is kept in one document only."""

from tilewright.llm import line_dedup


def test_hash_over_many_partitions(spark, docs_of):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = docs_of([f"A line that all documents hold.\nA line of document {i} alone." for i in range(200)])
        got = {r.doc_id: r["__text"] for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(got) == 200 and all(f"document {i - 1} alone" in t for i, t in got.items())
    assert [i for i, t in got.items() if t.startswith("A line that")] == [1]
