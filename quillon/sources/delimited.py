"""Delimited text, read strictly: nothing is dropped, replaced or renamed in silence.

UTF-8 files are read by all tasks, though a quote can hold an end of line anywhere: see `splits`. Files in
other encodings are read by one task each. Columns are c0, c1, ... with their names beside them, because names may
repeat; `file` and `rid` give the order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import DELIMITERS
from quillon.sources import bytes_in, splits
from quillon.sources.bytes_in import MARKS, Refused, decoded, format_of, refusal

DELIMITER_OF = {"csv": ",", "tsv": "\t", "psv": "|"}
_HEAD = 1 << 20
_BATCH = 20_000


@dataclass
class Table:
    """A table's rows (file, rid, c0, ...) and the names of its columns."""

    rows: DataFrame
    names: list[str]
    info: dict = field(default_factory=dict)


def records(text: str, delimiter: str = ",", quoting: bool = True) -> Iterator[list[str]]:
    """The records of a text.

    A quote opens a field only at its start, two of them are one inside, and what follows the
    closing one belongs to the field as it is. CR, LF and CRLF end a record outside quotes; the
    last one needs none. A blank line is a record of one empty cell; an open quote takes the rest.
    """
    scan = _field(delimiter, quoting)
    at, size, row = 0, len(text), []
    while at < size:
        m = scan(text, at)
        quoted, rest, bare, stop = m.groups()
        row.append(bare if bare is not None else quoted.replace('""', '"') + rest)
        at = m.end()
        if stop == delimiter:
            if at == size:
                row.append("")
        if stop != delimiter or at == size:
            yield row
            row = []


def _field(delimiter: str, quoting: bool = True):
    """Matches a field at a place: what is quoted, what follows the closing quote, or what is bare; and what ends it."""
    d = re.escape(delimiter)
    end = f"({d}|\r\n|\r|\n|\\Z)"
    return re.compile(f'(?:"([^"]*+(?:""[^"]*+)*+)(?:"|\\Z)([^{d}\r\n]*+)|([^{d}\r\n]*+)){end}' if quoting else f"()()([^{d}\r\n]*+){end}").match


def _rest(delimiter: str):
    """Matches the rest of a quoted field at a place, and, if it is closed, what follows and what ends it."""
    d = re.escape(delimiter)
    return re.compile(f'[^"]*+(?:""[^"]*+)*+(?:"([^{d}\r\n]*+)({d}|\r\n|\r|\n|\\Z))?').match


def _counted(text: str, inside: bool, delimiter: str, scan, rest) -> tuple[bool, int, int]:
    """(whether its end is inside a quote, records that end, fields that go on behind their closing quote) of a text of whole lines."""
    at, size, ended, bad = 0, len(text), 0, 0
    if inside:
        m = rest(text, 0)
        if m[2] is None:
            return True, 0, 0
        at, ended, bad, inside = m.end(), int(m[2] != delimiter), int(bool(m[1])), False
    while at < size:
        m = scan(text, at)
        at, stop = m.end(), m[4]
        if not stop:
            return True, ended, bad  # only an open quote runs through a line's end
        ended += stop != delimiter
        bad += bool(m[2])
    return inside, ended, bad


def _record_end(text: str, inside: bool, delimiter: str, scan, rest) -> tuple[int | None, bool]:
    """(place after the first record's end, False), or (None, True) if a quote is open at the text's end."""
    at, stop = 0, delimiter
    if inside:
        m = rest(text, 0)
        if m[2] is None:
            return None, True
        at, stop = m.end(), m[2]
    while stop == delimiter and at < len(text):
        m = scan(text, at)
        at, stop = m.end(), m[4]
    return (at, False) if stop else (None, True)


def _complete(text: str, delimiter: str, scan) -> tuple[list[list[str]], int]:
    """The records that end in a text of whole lines, and where the one begins that does not."""
    at, size, begun, row, rows = 0, len(text), 0, [], []
    while at < size:
        m = scan(text, at)
        quoted, rest, bare, stop = m.groups()
        if not stop:
            break
        row.append(bare if bare is not None else quoted.replace('""', '"') + rest)
        at = m.end()
        if stop != delimiter:
            rows.append(row)
            row, begun = [], at
    return rows, begun


def sniffed(header: str) -> str:
    """The commonest delimiter of a header line outside quotes, the first of equals; a comma if there is none."""
    line = re.split("[\r\n]", re.sub('"[^"]*"', "", header), maxsplit=1)[0]
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d))) if any(d in line for d in DELIMITERS) else ","


def fitted(row: list[str], width: int, number: int) -> list[str]:
    """The row at the header's width: short ones get empty cells, long ones lose empty cells only."""
    if len(row) <= width:
        return row + [""] * (width - len(row))
    extra = next((c for c in row[width:] if c), None)
    if extra is not None:
        raise Refused(f"row {number} has {len(row)} cells, the header {width}; the first one too many is {extra[:40]!r}")
    return row[:width]


def misused_quotes(text: str, delimiter: str) -> tuple[int, int, int]:
    """(fields whose opening quote is closed before the field's end, rows that do not fit with quoting, without)."""
    if '"' not in text:
        return 0, 0, 0
    scan, at, bad = _field(delimiter), 0, 0
    while at < len(text):
        m = scan(text, at)
        at, bad = m.end(), bad + bool(m[2])
    if not bad:
        return 0, 0, 0

    def ragged(quoting: bool) -> int:
        rows = records(text, delimiter, quoting)
        width = len(next(rows, []))
        return sum(len(r) < width or any(r[width:]) for r in rows)

    return bad, ragged(True), ragged(False)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, quoting: bool | None = None) -> Table:
    """The table of a delimited file, or of a folder of files with one header.

    Quoting is dropped only if that leaves fewer rows that do not fit than quoting leaves, misused
    quotes counted. Rows are numbered from 0 within their file. An empty input has no columns.
    """
    files = _files(spark, path)
    total = files.agg(F.min("path").alias("first"), F.coalesce(F.max(F.lower("path").rlike(splits.PACKED)), F.lit(False)).alias("packed")).first()  # no file is read for that
    if total["first"] is not None:
        reason = refusal(total["first"], b"")
        if reason:
            raise Refused(reason)
    if total["first"] is not None and not total["packed"] and (encoding is None or bytes_in.codec_of(encoding) == "utf-8"):
        found = _read_splits(spark, path, total["first"], delimiter, encoding, quoting)
        if found is not None:
            return found
    return _read_whole(spark, path, delimiter, encoding, quoting)


def _head_text(spark: SparkSession, path: str, delimiter: str | None, quoting: bool | None) -> tuple[bytes, str]:
    """The first bytes of a file, and as many of its first lines as its header has."""
    lines, n = splits.pieces(spark, path, "\n").where("start = 0").select("value"), 1
    while True:
        rows = [bytes(r["value"]) for r in lines.take(n)]
        raw = b"".join(r + b"\n" for r in rows)
        text = raw.decode(errors="ignore")
        open_ = lambda d: quoting is not False and _record_end(text, False, d, _field(d), _rest(d))[0] is None
        if len(rows) < n or len(raw) >= _HEAD or text.count('"') % 2 == 0 and not any(map(open_, (delimiter,) if delimiter else DELIMITERS)):
            return raw[:64], text
        n *= 16


def _read_splits(spark: SparkSession, path: str, first_path: str, delimiter: str | None, encoding: str | None, quoting: bool | None) -> Table | None:
    """read_delimited of UTF-8 files, by all tasks; None if they have to be read whole."""
    kind = format_of(first_path)
    delimiter = delimiter or DELIMITER_OF.get(kind)
    raw, head = _head_text(spark, first_path, delimiter, quoting)
    reason = refusal(first_path, raw)
    if reason:
        raise Refused(reason)
    if encoding is None and any(raw.startswith(m) and c != "utf-8" for m, c in MARKS):
        return None
    if not head:
        return Table(spark.createDataFrame([], "file string, rid long"), [])
    delimiter = delimiter or sniffed(head)
    lines = splits.pieces(spark, path, "\n")
    scan, rest, plain = _field(delimiter), _rest(delimiter), _field(delimiter, False)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in splits.stretches(batches, b"\n"):
            seen, ends = splits.Bytes(), 0
            out, inside = {False: [False, 0, 0], True: [True, 0, 0]}, (False, True) if key[1] else (False,)
            for size, raw in parts:
                text = seen.text(key, size, raw)
                ends += text.count("\n") + (len(re.findall("\r(?!\n)", text)) if "\r" in text else 0)
                counted = {state: _counted(text, state, delimiter, scan, rest) for state in {out[i][0] for i in inside}}
                for i in inside:
                    state, n, bad = counted[out[i][0]]
                    out[i] = [state, out[i][1] + n, out[i][2] + bad]
            yield pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "found": json.dumps({**seen.found(), "ends": ends, "out": [out[False], out[True]]})}], pa.schema([("file", pa.string()), ("start", pa.int64()), ("found", pa.string())]))

    found = splits.by_file([{"file": r["file"], "start": r["start"], **json.loads(r["found"])} for r in lines.mapInArrow(survey, "file string, start long, found string").collect()])
    if encoding is None and any(s["mark"] for file in found.values() for s in file):
        return None
    closed = {file: splits.checked(parts) for file, parts in found.items()}

    def planned(quoting: bool) -> tuple[int, dict, dict] | None:
        """Misused quotes; (inside a quote, records ended before, whether the last line's end is no part of it) of each split; what is added to them."""
        bad, plan = 0, {}
        for file, parts in found.items():
            inside, done = False, 0
            for s in parts:
                plan[file, s["start"]] = (inside, done, False)
                if quoting:
                    begun = (file, s["start"]) if not inside or s["out"][1][1] else begun
                    inside, n, b = s["out"][inside]
                    done, bad = done + n, bad + b
                else:
                    done += s["ends"]
            if inside and not closed[file]:
                plan[begun] = (*plan[begun][:2], True)
        heads = splits.heads(lines, b"\n", {k: True for k, v in plan.items() if v[0]}, lambda text, inside: _record_end(text, inside, delimiter, scan, rest))
        return None if heads is None else (bad, plan, splits.tails({file: [(file, s["start"]) for s in parts] for file, parts in found.items()}, heads))

    def rows(batches: Iterator[pa.RecordBatch], quoting: bool, plan: dict, tails: dict) -> Iterator[tuple[str, int, list[list[str]]]]:
        """(file, number of the first record, records) of each stretch; a file's header has number 0."""
        match = scan if quoting else plain
        for key, parts in splits.stretches(batches, b"\n"):
            inside, at, cut = splits.of(plan, key)
            file, held, at = splits.plain_path(key[0]), "", at + inside
            for _, raw in parts:
                text = raw.decode()
                if inside:
                    begin, inside = _record_end(text, True, delimiter, scan, rest)
                    if inside:
                        continue
                    text = text[begin:]
                text = held + text
                done, begin = _complete(text, delimiter, match)
                held = text[begin:]
                yield file, at, done
                at += len(done)
            if held:
                held += tails.get(key, "")
                yield file, at, list(records(held[:-1] if cut else held, delimiter, quoting))

    def misfits(quoting: bool, plan: dict, tails: dict) -> int:
        width = len(next(records(head, delimiter, quoting), []))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, at, done in rows(batches, quoting, plan, tails):
                yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(r) < width or any(r[width:]) for r in done[at == 0 :])], pa.int64())})

        return lines.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0

    made = planned(quoting is not False)
    if made is None:
        return None
    bad, plan, tails = made
    if quoting is None:
        quoting = True
        if bad:
            _, *other = planned(False)
            quoting = not misfits(False, *other) < bad + misfits(True, plan, tails)
            plan, tails = (plan, tails) if quoting else other
    names = next(records(head, delimiter, quoting), [])
    if any("\x00" in n for n in names):
        raise Refused("a column's name holds a NUL byte")
    width = len(names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, at, done in rows(batches, quoting, plan, tails):
            fit = [fitted(row, width, n) for n, row in enumerate(done, at) if n]
            for i in range(0, len(fit), _BATCH):
                yield _batch(file, max(at - 1, 0) + i, fit[i : i + _BATCH], width)

    schema = ", ".join(["file string", "rid long", *(f"c{i} string" for i in range(width))])
    return Table(lines.mapInArrow(parse, schema), names, {"delimiter": delimiter, "quoting": quoting})


def _read_whole(spark: SparkSession, path: str, delimiter: str | None, encoding: str | None, quoting: bool | None) -> Table:
    """read_delimited of files in any encoding, each by one task."""
    files = _files(spark, path)
    first_path = files.agg(F.min("path")).first()[0]  # no file is read for that
    head = None
    if first_path is not None:
        head = spark.read.format("binaryFile").load(first_path).select("path", F.substring("content", 1, _HEAD).alias("head"), F.length("content").alias("n")).first()
    if head is None or not head["n"]:
        return Table(spark.createDataFrame([], "file string, rid long"), [])
    reason = refusal(head["path"], bytes(head["head"]))
    if reason:
        raise Refused(reason)
    first = bytes(head["head"])
    if head["n"] > _HEAD:  # a cut character at the end is no error of the file
        text = first.decode(next((c for m, c in MARKS if first.startswith(m)), "utf-8") if encoding is None else encoding, errors="ignore").lstrip("﻿")
    else:
        text = decoded(first, encoding)
    if delimiter is None:
        kind = format_of(head["path"])
        delimiter = DELIMITER_OF.get(kind) or sniffed(text)
    if quoting is None:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for raw in b.column("content"):
                    counts = misused_quotes(decoded(raw.as_py(), encoding), delimiter)
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in counts], names=["bad", "quoted", "plain"])

        total = files.select("content").mapInArrow(scan, "bad long, quoted long, plain long").agg(*[F.sum(c).alias(c) for c in ("bad", "quoted", "plain")]).first()
        quoting = not (total["bad"] and total["plain"] < total["bad"] + total["quoted"])
    names = next(records(text, delimiter, quoting), [])
    if any("\x00" in n for n in names):
        raise Refused("a column's name holds a NUL byte")
    width = len(names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content")):
                rows = records(decoded(raw.as_py(), encoding), delimiter, quoting)
                next(rows, None)
                start, held = 0, []
                for n, row in enumerate(rows):
                    held.append(fitted(row, width, n + 1))
                    if len(held) == _BATCH:
                        yield _batch(file, start, held, width)
                        start, held = n + 1, []
                if held:
                    yield _batch(file, start, held, width)

    schema = ", ".join(["file string", "rid long", *(f"c{i} string" for i in range(width))])
    return Table(files.mapInArrow(parse, schema), names, {"delimiter": delimiter, "quoting": quoting})


def _batch(file: str, start: int, rows: list[list[str]], width: int) -> pa.RecordBatch:
    columns = list(zip(*rows)) if width else []
    arrays = [pa.array([file] * len(rows), pa.string()), pa.array(range(start, start + len(rows)), pa.int64()), *(pa.array(c, pa.string()) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, names=["file", "rid", *(f"c{i}" for i in range(width))])


# -- large files, split by lines ------------------------------------------------------------


def line_record(line: str, delimiter: str = ",", quoting: bool = True) -> list[str]:
    """The one record of a line; a quote that the line does not close is refused."""
    if quoting and line.count('"') % 2 and re.search(f'(?:^|{re.escape(delimiter)})"(?:[^"]|"")*\\Z', line):
        raise Refused(f"a quote holds an end of line at {line[:40]!r}; the file has to be read whole")
    return next(records(line, delimiter, quoting), [""])


def read_delimited_lines(spark: SparkSession, path: str, delimiter: str | None = None, quoting: bool = True) -> Table:
    """The same table as read_delimited for UTF-8 files in which no quote holds an end of line, read by all
    tasks: a file is split, and a row's number is its place in its split after the lines of earlier splits.

    A CR before a LF ends the line with it; any other CR is refused, as are bytes that are no UTF-8.
    """
    source = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    lines = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("Refused: not UTF-8 in "), F.col("_metadata.file_path")))).alias("value"))
    head = lines.where("start = 0").select("file", "value").first()
    if head is None:
        return Table(spark.createDataFrame([], "file string, rid long"), [])
    header = head["value"].removeprefix("﻿").removesuffix("\r")
    if delimiter is None:
        delimiter = DELIMITER_OF.get(format_of(head["file"])) or sniffed(header)
    names = line_record(header, delimiter, quoting)
    width = len(names)
    before = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each split
    first: dict[tuple[str, int], int] = {}
    for file in sorted({r["file"] for r in before}):
        at = -1  # the header is no row
        for r in sorted((r for r in before if r["file"] == file), key=lambda r: r["start"]):
            first[file, r["start"]] = at
            at += r["n"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[str, int], int] = {}
        for b in batches:
            files, numbers, rows = [], [], []
            for file, start, line in zip(*(b.column(c).to_pylist() for c in ("file", "start", "value"))):
                rid = first[file, start] + met.get((file, start), 0)
                met[file, start] = met.get((file, start), 0) + 1
                if rid < 0:
                    continue
                line = line.removesuffix("\r")
                if "\r" in line:
                    raise Refused(f"a line of {file} holds a CR; the file has to be read whole")
                files.append(file)
                numbers.append(rid)
                rows.append(fitted(line_record(line, delimiter, quoting), width, rid + 1))
            columns = list(zip(*rows)) if rows else [[]] * width
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(numbers, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=["file", "rid", *(f"c{i}" for i in range(width))])

    schema = ", ".join(["file string", "rid long", *(f"c{i} string" for i in range(width))])
    return Table(lines.mapInArrow(parse, schema), names, {"delimiter": delimiter, "quoting": quoting})
