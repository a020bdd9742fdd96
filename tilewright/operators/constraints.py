"""Integrity constraints as queries: each gives (name, violations), so a run's report is their union."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Broken(ValueError):
    """A constraint has violations."""


def _row(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").cast("long").alias("violations")).select(F.lit(name).alias("name"), "violations")


def all_in(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    return _row(df.join(other.select(key), key, "left_anti"), name)


def disjoint(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    return _row(df.select(key).join(other.select(key), key, "left_semi").distinct(), name)


def same_rows(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Rows of either side that the other lacks, counting repeats."""
    return _row(df.exceptAll(other).unionAll(other.exceptAll(df)), name)


def same_count(df: DataFrame, expected: DataFrame, by: str, name: str) -> DataFrame:
    """Groups whose count differs from ``expected`` (by, n)."""
    have = df.groupBy(by).agg(F.count("*").alias("__have"))
    both = have.join(expected.select(by, F.col("n").alias("__want")), by, "full")
    return _row(both.where(F.coalesce("__have", F.lit(0)) != F.coalesce("__want", F.lit(0))), name)


def grew_by(before: DataFrame, after: DataFrame, added: DataFrame, name: str) -> DataFrame:
    """Whether ``after`` has as many rows as ``before`` and ``added`` together."""
    n = lambda d, c: d.agg(F.count("*").alias(c))
    one = n(before, "a").crossJoin(n(after, "b")).crossJoin(n(added, "c"))  # three single rows
    return _row(one.where("b <> a + c"), name)


def polarity_gate(df: DataFrame, source: str, darker: str, least: int = 20, share: float = 0.8, name: str = "polarity") -> DataFrame:
    """Sources with at least ``least`` instances of which fewer than ``share`` are darker."""
    per = df.groupBy(source).agg(F.count(darker).alias("n"), F.avg(F.col(darker).cast("double")).alias("s"))
    return _row(per.where((F.col("n") >= least) & (F.col("s") < share)), name)


def arms_equal(df: DataFrame, arm: str, bucket: str, keep: str, name: str) -> DataFrame:
    """Buckets in which the arms keep different numbers of rows."""
    per = df.groupBy(bucket, arm).agg(F.count_if(F.col(keep)).alias("n"))
    return _row(per.groupBy(bucket).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo <> hi"), name)


def empty_labels(labels: DataFrame, selected: int, trimmed: int, name: str = "null tiles as selected", text: str = "label_text") -> DataFrame:
    """Whether as many labels are blank as null tiles were selected, less those trimmed."""
    n = labels.agg(F.count_if(F.trim(F.regexp_replace(text, r"\s", "")) == "").alias("n"))
    return _row(n.where(F.col("n") != selected - trimmed), name)


def rows_as_reported(rows: DataFrame, report: DataFrame, name: str = "rows as reported") -> DataFrame:
    """Whether a report's counts (n) add up to the number of rows."""
    one = rows.agg(F.count("*").alias("a")).crossJoin(report.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("b")))  # two single rows
    return _row(one.where("a <> b"), name)


def report(checks: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, checks)


def enforce(checks: Iterable[DataFrame]) -> None:
    broken = report(checks).where("violations > 0").collect()
    if broken:
        raise Broken(", ".join(f"{r.name}: {r.violations}" for r in broken))
