"""Sinks: JSON and line files, tile folders, registered tables, split files."""

from __future__ import annotations

import json
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local(path: str) -> Path:
    """A mounted folder; other schemes need a mounted path."""
    p = urlparse(path)
    if p.scheme not in ("", "file"):
        raise ValueError(f"{path}: tile files go to a mounted folder")
    return Path(p.path)


def json_summary(value: dict, path: str) -> None:
    """A small document, indented, not escaped; folders are made."""
    at = local(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def repeat_list(df: DataFrame, path: str, line: str, copies: str = "copies") -> None:
    """One line a copy."""
    rows = df.where(F.col(copies) > 0).select(F.explode(F.array_repeat(F.col(line), F.col(copies).cast("int"))).alias("value"))
    rows.write.mode("overwrite").text(path)


def label_text(boxes: str = "boxes"):
    """Label lines of array<struct<class_id, cx, cy, w, h>>: one trailing line feed iff there is a line."""
    lines = F.transform(boxes, lambda b: F.format_string("%d %.6f %.6f %.6f %.6f", b["class_id"], b["cx"], b["cy"], b["w"], b["h"]))
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def tile_folder(df: DataFrame, root: str) -> DataFrame:
    """Write ``images/{part}/{tile}.png`` and ``labels/{part}/{tile}.txt`` of rows (part, tile, label_text, png) and return what was
    written, or reused: an image that is there with the same bytes stays. Writes go to a temporary name first, so a repeated task
    does no harm."""
    base = str(local(root))

    def write(batches):
        import os
        import uuid

        def put(at: Path, body: bytes) -> bool:
            at.parent.mkdir(parents=True, exist_ok=True)
            if at.exists() and at.read_bytes() == body:
                return False
            tmp = at.with_name(f".{uuid.uuid4().hex}")
            tmp.write_bytes(body)
            os.replace(tmp, at)
            return True

        for b in batches:
            out = []
            for r in b.to_pylist():
                new = put(Path(base, "images", r["part"], f"{r['tile']}.png"), r["png"])
                put(Path(base, "labels", r["part"], f"{r['tile']}.txt"), r["label_text"].encode())
                out.append({"part": r["part"], "tile": r["tile"], "reused": not new})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.string()), ("tile", pa.string()), ("reused", pa.bool_())]))

    return df.select("part", "tile", "label_text", "png").mapInArrow(write, "part string, tile string, reused boolean")


def register(df: DataFrame, path: str, name: str, version: str, params: dict, partition: tuple[str, ...] = ()) -> None:
    """A dataset version: Parquet and a document of its name, version, parameters and row count. A version is written once."""
    df.write.mode("error").partitionBy(*partition).parquet(f"{path}/{name}/{version}/data")
    n = df.sparkSession.read.parquet(f"{path}/{name}/{version}/data").count()
    json_summary({"name": name, "version": version, "params": params, "rows": n}, f"{path}/{name}/{version}/dataset.json")


def data_yaml(path: str, root: str, names: list[str], parts: dict[str, str], params: dict | None = None) -> None:
    """Class names, split folders and the parameters that made them."""
    lines = [f"path: {root}", *(f"{k}: {v}" for k, v in parts.items()), "names:", *(f"  {i}: {n}" for i, n in enumerate(names))]
    if params:
        lines += ["params:", *(f"  {k}: {json.dumps(v, ensure_ascii=False)}" for k, v in sorted(params.items()))]
    at = local(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("\n".join(lines) + "\n", encoding="utf-8")


def symlink_view(tiles: DataFrame, root: str, view: str) -> DataFrame:
    """(part, tile) of links ``{view}/images/{part}/{tile}.png`` and labels beside them to a dataset's files; ``tiles``: part (of the
    view), tile, stored (the part whose folder holds it). Links that are there are replaced, so a task may run again."""
    base, target = str(local(root)), str(local(view))

    def write(batches):
        import os
        import uuid

        for b in batches:
            for r in b.select(["part", "tile", "stored"]).to_pylist():
                for kind, end in (("images", "png"), ("labels", "txt")):
                    at = Path(target, kind, r["part"], f"{r['tile']}.{end}")
                    at.parent.mkdir(parents=True, exist_ok=True)
                    tmp = at.with_name(f".{uuid.uuid4().hex}")
                    tmp.symlink_to(Path(base, kind, r["stored"], at.name))
                    os.replace(tmp, at)
            yield b.select(["part", "tile"])

    return tiles.select("part", "tile", "stored").mapInArrow(write, "part string, tile string")


def in_batches(rows: DataFrame, work, path: str, key: str, batches: int) -> DataFrame:
    """``work`` of all rows, appended to ``path`` in ``batches`` parts by a hash of the key. A part is committed whole, so after a failure
    another call does what is missing."""
    spark = rows.sparkSession
    todo = rows.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
    for k in range(batches):
        at = f"{path}/part={k}"
        if not local(at).joinpath("_SUCCESS").exists():
            work(todo.where(F.col("__part") == k).drop("__part")).write.mode("overwrite").parquet(at)
    return spark.read.parquet(path).drop("part")


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A report's table of at most ``limit`` rows; what is left out is said in a last line."""
    rows = df.limit(limit + 1).collect()
    head = "| " + " | ".join(df.columns) + " |"
    more = [f"| ... more than {limit} rows |" + " |" * (len(df.columns) - 1)] if len(rows) > limit else []
    return "\n".join([head, "|" + "---|" * len(df.columns), *("| " + " | ".join(map(str, r)) + " |" for r in rows[:limit]), *more])
