"""Archives of the original bytes of statistics files: kept whole, restored byte for byte.

A Stata file's rows have a fixed width, and its bytes compress better column by column; so the region of rows is
turned before it is compressed, in bands of rows so that a band's bytes are bounded. A file is cut
into parts of bounded size, each compressed, restored and compared in the task that made it.
"""

from __future__ import annotations

import hashlib
import json
import lzma
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans import codec
from quillon.sources import stata
from quillon.sources.bytes_in import Refused, format_of
from quillon.sources.delimited import _files

#: Bytes of a part, and so of a band of rows.
PART = 64 << 20


def bands(raw: bytes, kind: str, most: int = PART) -> list[tuple[int, int, int]]:
    """(start, end, row width or 0) of a file's parts, in order; a part with a width holds whole rows."""
    start, width, rows = stata.region(raw) if kind == "dta" else (0, 0, 0)
    parts: list[tuple[int, int, int]] = []

    def cut(a: int, b: int, step: int, wide: int) -> None:
        parts.extend((x, min(x + step, b), wide) for x in range(a, b, step))

    if width < 2 or rows < 2:
        cut(0, len(raw), most, 0)
        return parts
    cut(0, start, most, 0)
    cut(start, start + width * rows, max(1, most // width) * width, width)
    cut(start + width * rows, len(raw), most, 0)
    return parts


def turned(part: bytes, width: int) -> bytes:
    """The bytes of rows column by column."""
    return np.frombuffer(part, np.uint8).reshape(-1, width).T.tobytes() if width else part


def returned(part: bytes, width: int) -> bytes:
    return np.frombuffer(part, np.uint8).reshape(width, -1).T.tobytes() if width else part


def encoded(files: DataFrame, kind: str, most: int = PART) -> DataFrame:
    """file, part, start, width, n_bytes, sha256 (of the whole file), data of every part of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, value in zip(b.column("path").to_pylist(), b.column("content")):
                raw = value.as_py()
                digest = hashlib.sha256(raw).hexdigest()
                for k, (start, end, width) in enumerate(bands(raw, kind, most)):
                    data = lzma.compress(turned(raw[start:end], width), preset=6)
                    if returned(lzma.decompress(data), width) != raw[start:end]:
                        raise codec.Damaged(f"{file} did not come back as it was")
                    row = (file, k, start, width, end - start, digest, data)
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["file", "part", "start", "width", "n_bytes", "sha256", "data"])

    return files.select("path", "content").mapInArrow(run, "file string, part long, start long, width long, n_bytes long, sha256 string, data binary")


def write_originals(spark: SparkSession, source: str, path: str, most: int = PART) -> None:
    """parts/ of at most `most` bytes of the files at `source` (whole rows, where turned), and last plan/ with their format and number."""
    kind = format_of(source)
    if kind not in ("dta", "xpt", "sav", "zsav", "por", "sas7bdat"):
        raise Refused(f"{kind} files are kept as tables, not as their bytes")
    encoded(_files(spark, source), kind, most).write.option("compression", "uncompressed").parquet(f"{path}/parts")
    plan = json.dumps({"v": codec.VERSION, "original": kind})
    spark.createDataFrame([(plan,)], "plan string").coalesce(1).write.parquet(f"{path}/plan")


def read_originals(spark: SparkSession, path: str) -> DataFrame:
    """file, content: the bytes of each file as they were; a part that is missing or damaged is an error."""
    plan = json.loads(spark.read.parquet(f"{path}/plan").first()["plan"])
    if plan["v"] > codec.VERSION or "original" not in plan:
        raise codec.Damaged("this is no archive of original files")

    def restore(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        file, digest = group.column("file")[0].as_py(), group.column("sha256")[0].as_py()
        out, rows = bytearray(), zip(*(group.column(c).to_pylist() for c in ("part", "start", "width", "n_bytes", "data")))
        for k, (part, start, width, n, data) in enumerate(rows):
            try:
                # the length is known before, so that no part can fill the worker
                raw = lzma.LZMADecompressor().decompress(data, max_length=n + 1)
            except lzma.LZMAError as e:
                raise codec.Damaged(f"a part of {file} is damaged: {e}") from None
            if part != k or start != len(out) or len(raw) != n or width and n % width:
                raise codec.Damaged(f"a part of {file} is missing or damaged")
            out += returned(raw, width)
        if hashlib.sha256(out).hexdigest() != digest:
            raise codec.Damaged(f"{file} is not what it was")
        return pa.table({"file": pa.array([file]), "content": pa.array([bytes(out)], pa.binary())})

    parts = spark.read.parquet(f"{path}/parts")
    return parts.groupBy("file").applyInArrow(restore, "file string, content binary")
