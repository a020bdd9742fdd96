"""Line dedup in the pipeline keeps a document's own short lines."""

import corpus_pipeline as P


def test_own_short_lines_stay(spark, docs_of, tmp_path):
    texts = ["A line that is shared.", "Roses red\nA line that is shared.\nSky blue", "A line that is shared.\n \n"]
    got = P.dedup_lines(spark, docs_of(texts), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, texts[0]), (2, "Roses red\nSky blue")]
