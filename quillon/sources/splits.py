"""Large files of text read by all tasks: a file's splits in pieces that end at a separator.

Where a split begins, its task cannot know whether it is inside a quote or a record. So a first pass
goes through every split once for each possibility and returns what either would leave behind; following the splits
of a file from its start then tells which one holds. The record that a split's end cuts is finished by the task of the split in
which it begins, with the rest from the splits behind it (`heads`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.bytes_in import MARKS, Refused

#: A record that is cut by splits is finished through the driver up to so many bytes behind the first cut.
HEAD_BYTES = 1 << 26
#: Endings that Spark's line reader would decompress, beside those that are refused.
PACKED = r"\.(deflate|snappy|lz4|lzo|lzo_deflate|zstd|passthrough)$"
_BOM = b"\xef\xbb\xbf"

Key = tuple[str, int]


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, start (of the split), size (of the file), value: the bytes between separators, in order within a split."""
    source = spark.read.option("recursiveFileLookup", "true").option("lineSep", separator).text(path)
    rows = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    # a plan anew would split anew, by the settings and executors of its time; the scan's RDD keeps its splits
    plan = rows._jdf.queryExecution()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), plan.analyzed().schema(), False), spark)


def plain_path(file: str) -> str:
    """A file's path as the reader of whole files gives it."""
    return re.sub(r"^([A-Za-z][\w+.-]*):///", r"\1:/", unquote(file))


def stretches(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[Key, Iterator[tuple[int, bytes]]]]:
    """Each split with (size of its file, bytes) of its stretches: some of its pieces, a separator after each."""

    def parts() -> Iterator[tuple[Key, int, bytes]]:
        for b in batches:
            if not b.num_rows:
                continue
            files, starts, sizes, values = (b.column(c) for c in ("file", "start", "size", "value"))
            at = 0
            for key, run in groupby(zip(files.to_pylist(), starts.to_pylist())):
                n = sum(1 for _ in run)
                yield key, sizes[at].as_py(), separator.join([*values[at : at + n].to_pylist(), b""])
                at += n

    for key, run in groupby(parts(), key=lambda p: p[0]):
        yield key, ((size, raw) for _, size, raw in run)


class Bytes:
    """What holds for the bytes of a split whatever they mean: how many, a mark at the start, the first wrong one."""

    def __init__(self) -> None:
        self.size, self.n, self.mark, self.wrong, self.byte = 0, 0, "", -1, 0

    def text(self, key: Key, size: int, raw: bytes) -> str:
        """A stretch as text; from the first wrong byte on, none."""
        if not self.n and not key[1]:
            self.mark = next((c for m, c in MARKS if raw.startswith(m) and c != "utf-8"), "")
        self.size = size
        try:
            return raw.decode() if self.wrong < 0 else ""
        except UnicodeDecodeError as e:
            self.wrong, self.byte = self.n + e.start, raw[e.start]
            return ""
        finally:
            self.n += len(raw)

    def found(self) -> dict:
        return {"size": self.size, "n": self.n, "mark": self.mark, "wrong": self.wrong, "byte": self.byte}


def by_file(found: list[dict]) -> dict[str, list[dict]]:
    """A pass's results, file by file, in order."""
    out: dict[str, list[dict]] = {}
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        out.setdefault(r["file"], []).append(r)
    return out


def checked(splits: list[dict]) -> bool:
    """Whether a file ends with a separator. Bytes that are not UTF-8 are refused."""
    total, size = sum(s["n"] for s in splits), splits[0]["size"]
    skipped = len(_BOM) if total < size else 0  # the reader skips a mark at the start
    at = skipped
    for s in splits:
        if s["wrong"] >= 0:
            raise Refused(f"byte 0x{s['byte']:02x} at {at + s['wrong']} is not utf-8")
        at += s["n"]
    return total + skipped == size


def of(plan: dict[Key, object], key: Key):
    if key not in plan:
        raise RuntimeError(f"{key[0]} was split otherwise before")
    return plan[key]


def heads(rows: DataFrame, separator: bytes, states: dict[Key, object], head: Callable[[str, object], tuple[int | None, object]]) -> dict[Key, tuple[str, bool]] | None:
    """(text, whether the record ends there) of what each of the splits in `states` begins with and belongs to a
    record before it; None if that is too much. `head` takes a text and a state to the place after the record's end or None, and a state."""
    if not states:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in stretches(batches, separator):
            if key not in states:
                continue
            state, at, found, n = states[key], None, [], 0
            for _, raw in parts:
                text = raw.decode()
                at, state = head(text, state)
                found.append(text[:at])
                n += len(raw)
                if at is not None or n > HEAD_BYTES:
                    break
            long = n > HEAD_BYTES and at is None
            yield pa.RecordBatch.from_pydict({"file": [key[0]], "start": [key[1]], "text": [None if long else "".join(found)], "ends": [at is not None]}, pa.schema([("file", pa.string()), ("start", pa.int64()), ("text", pa.string()), ("ends", pa.bool_())]))

    starts = sorted({s for _, s in states})
    rows = rows.where(F.col("start").isin(starts)) if len(starts) <= 1000 else rows
    found = rows.mapInArrow(run, "file string, start long, text string, ends boolean")
    if (found.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(HEAD_BYTES + 1)))).first()[0] or 0) > HEAD_BYTES:
        return None
    return {(r["file"], r["start"]): (r["text"], r["ends"]) for r in found.collect()}


def tails(splits: dict[str, list[Key]], found: dict[Key, tuple[str, bool]]) -> dict[Key, str]:
    """What the splits behind each split add to the record that its end cuts."""
    out: dict[Key, str] = {}
    for keys in splits.values():
        owner, parts = None, []
        for key in keys:
            if key in found:
                parts.append(found[key][0])
                if not found[key][1]:
                    continue
            if owner is not None and parts:
                out[owner] = "".join(parts)
            owner, parts = key, []
        if owner is not None and parts:
            out[owner] = "".join(parts)
    return out
