"""A training corpus from raw documents, in five stages; each works on all that the one before kept.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents; n_chars follows the text. A null
or repeated doc_id, null or empty texts and extra columns are handled as the operators say; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C
from tilewright.llm import decontamination, line_dedup, minhash_dedup, quality_rules, sentencepiece_codec

REST = ("doc_id", "lang", "source")


def _documents(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule go, and so do the documents that the quality rules reject."""
    return _documents(quality_rules.quality(docs, keep=REST).where("kept"), "clean_text")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document. A document that loses lines and keeps none but blank ones goes."""
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), keep=REST)
    own = F.exists(F.split("__text", "\n"), lambda x: F.length(F.btrim(x, F.lit(line_dedup.BLANKS))) > 0)
    return _documents(done.where((F.col("__n_dropped") == 0) | own), "__text")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, similarity 0.8) the document with the smallest id stays."""
    docs = docs.select(*C.DOCUMENT_COLUMNS)
    gone = C.written(minhash_dedup.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*C.DOCUMENT_COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = decontamination.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=REST)
    return _documents(found.where(F.size("__leaks") == 0), "__whole")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document."""
    return sentencepiece_codec.encode(docs, keep=REST)


STAGES = [
    ("quality_rules", clean),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]
ORACLE_SQL = None  # sampled pieces and banded alignment are beyond SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        kept = set(C.made)
        out = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        C.forget(spark, *(set(C.made) - kept - {out._scratch}))  # what the stage wrote on its way
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
