"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens, then a worker's own cache.

A SentencePiece BPE segmentation splits into independent parts wherever no piece of the vocabulary spans a cut. No piece
has a space mark but at its start, so ``space run + word`` is such a part (a pre-token); if no piece holds a line feed,
line feeds are parts of their own. The count of a text is the sum over its parts, each looked up first among the
frequent ones, then in the worker's cache, and only then encoded. Nothing is shuffled.

Results: a null or empty text has 0 tokens; texts with U+2581 or U+0000, for which cuts are not safe, are encoded
whole; repeated rows and null ids are counted like any other row; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C

MODEL = "piece_bpe_32k.model"
SAMPLE_DOCS = 1_000  # documents from which the frequent tier is taken; affects speed only
SAMPLE_CHARS = 20_000  # longer texts stay out of that sample, so the sample is at most 2 * 1,000 * 20,000 characters
FREQUENT = 30_000  # entries of the broadcast table, each at most UNIT_CHARS long
UNIT_CHARS = 64  # longer pre-tokens are encoded each time
CACHE = 400_000  # entries of a worker's cache


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitLengths(dict):
    """pre-token -> number of pieces, filled on demand."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None, size: int = CACHE):
        import sentencepiece

        super().__init__(frequent or {})
        self.frequent, self.size = frequent or {}, size
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        feeds = any("\n" in self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.units = re.compile(r" *[^ ]+| +" if feeds else r" *[^ \n]+| +|\n").findall
        self.feed = len(self.sp.encode("\n"))

    def __missing__(self, unit: str) -> int:
        if unit == " ":
            n = 1
        elif unit[0] == " ":  # the encoder puts one space mark before what it is given
            n = len(self.sp.encode(unit[1:]))
        elif unit == "\n":
            n = self.feed - 1
        else:  # after a line feed: without the mark
            n = len(self.sp.encode("\n" + unit)) - self.feed
        if len(unit) <= UNIT_CHARS:
            self[unit] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "▁" in text or "\0" in text:
            return len(self.sp.encode(text))
        if len(self) > self.size:
            self.clear()
            self.update(self.frequent)
        return sum(map(self.__getitem__, self.units(" " + text)))


def frequent_units(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """The FREQUENT most common pre-tokens of a bounded sample, with their lengths."""
    from collections import Counter

    lengths, seen = UnitLengths(path), Counter()
    rows = docs.select(F.col(text_col).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    for row in C.bounded_sample(rows, SAMPLE_DOCS, F.col("text"), docs.count()).toLocalIterator():
        seen.update(lengths.units(" " + row.text))
    return {u: lengths[u] for u, _ in seen.most_common(FREQUENT) if len(u) <= UNIT_CHARS}


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens as the library's encoder gives them."""
    path = path or model_path()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, path, text_col))

    def make():
        lengths = UnitLengths(path, frequent.value)

        def f(batch):
            n = [lengths.count(x) for x in C.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    return C.map_batches(rows, make, "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 4096)
