"""What the training-data operators share: reading tables, folds, shared scratch tables, Arrow batches.

Conventions that hold for every operator of this subpackage:

* an operator first selects the columns it needs by name, so extra columns, whatever their names, never clash;
* a null text is an empty text unless an operator says otherwise;
* tables that are read more than once are written to the shared folder named by ``spark.checkpoint.dir``, so a lost
  executor only costs the tasks it ran.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_own_dir: list[str] = []
made: list[str] = []  # paths of the tables written and not removed


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only on a local master without a setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tilewright-"))
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Remove written tables that no result needs any more."""
    for path in (t if isinstance(t, str) else t._scratch for t in tables):
        if path in made:
            made.remove(path)
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(n))


def held_out(doc_id: Column | str, n: int, remainder: int) -> Column:
    """Whether the row is in the held-out fold; a null id is not, and is not learned from either (its fold is null)."""
    return F.coalesce(fold(doc_id, n) == remainder, F.lit(False))


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state: ``make`` runs once a task and returns the function for its batches."""

    def run(batches):
        f, rows = make(), 0
        for batch in batches:
            if batch.num_rows:
                rows += batch.num_rows
                yield from f(batch)
        del f
        if rows > 1000:
            release()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def bounded_sample(df: DataFrame, n: int, key: Column, total: int | None = None) -> DataFrame:
    """About ``n`` rows, at most ``2 * n``, chosen by a hash of ``key``: the same rows however the input is dealt out.

    ``total`` (counted if not given) sets the share; the final limit is over a set already of that size.
    """
    total = df.count() if total is None else total
    if total <= n:
        return df
    share = min(1.0, 1.2 * n / total)
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * n)
