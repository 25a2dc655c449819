"""JSON records and JSON columns as tables of text.

Columns come in the order in which their keys are first met; numbers keep their own text,
null and missing keys are empty, nested values are compact JSON, of equal keys the last counts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import splits
from quillon.sources.bytes_in import Refused, codec_of, decoded
from quillon.sources.delimited import _BATCH, Table, _files

DEPTH, NUMBER_CHARS = 512, 78
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


class Number(str):
    """A number by its own text."""


def _number(token: str) -> Number:
    if len(token) > NUMBER_CHARS:
        raise Refused(f"a number of {len(token)} characters")
    return Number(token)


_decoder = json.JSONDecoder(parse_int=_number, parse_float=_number, parse_constant=_number, object_pairs_hook=dict, strict=False)


def _check_depth(text: str, depth: int = 0) -> None:
    if text.count("{") + text.count("[") + depth <= DEPTH:
        return
    for c in re.sub(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "", text, flags=re.S):
        if c in "[{":
            depth += 1
            if depth > DEPTH:
                raise Refused(f"values are nested more than {DEPTH} deep")
        elif c in "]}":
            depth -= 1


def parsed(text: str) -> object:
    _check_depth(text)
    try:
        return _decoder.decode(text)
    except json.JSONDecodeError as e:
        raise Refused(f"not JSON: {e.msg} at {e.pos}") from None


def quoted(text: str) -> str:
    """A JSON string in which only quotes, backslashes and control characters are escaped."""
    return '"' + re.sub(r'["\\\x00-\x1f]', lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def compact(value: object) -> str:
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return quoted(value)
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, list):
        return "[" + ",".join(map(compact, value)) + "]"
    return "{" + ",".join(f"{quoted(k)}:{compact(v)}" for k, v in value.items()) + "}"


def cell(value: object) -> str:
    """What a value is in a table of text."""
    return "" if value is None else str(value) if isinstance(value, str) else compact(value)


def rows(text: str, lines: bool) -> Iterator[dict[str, str]]:
    """The records of a document: an array of objects, an object of arrays, or an object for each line."""
    if lines:
        for n, line in enumerate(text.split("\n")):
            if line.strip():
                record = parsed(line)
                if not isinstance(record, dict):
                    raise Refused(f"line {n + 1} is no object")
                yield {k: cell(v) for k, v in record.items()}
        return
    document = parsed(text)
    if isinstance(document, list):
        for n, record in enumerate(document):
            if not isinstance(record, dict):
                raise Refused(f"record {n + 1} is no object")
            yield {k: cell(v) for k, v in record.items()}
    elif isinstance(document, dict):
        for k, v in document.items():
            if not isinstance(v, list):
                raise Refused(f"column {k!r} is no list")
        for i in range(max(map(len, document.values()), default=0)):
            yield {k: cell(v[i]) if i < len(v) else "" for k, v in document.items()}
    else:
        raise Refused("the document is one value")


#: Runs to the next bracket outside strings, to the end, or to a string that the end cuts; and through the rest of a string.
_bracket = re.compile(r'(?:[^"{}\[\]]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+([{}\[\]"]|\Z)', re.S).match
_string_end = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+(")?', re.S).match
_first_gap, _gap, _last_gap = (re.compile(rf"[ \t\n\r]*{c}[ \t\n\r]*").fullmatch for c in (r"\[", ",", r"\]"))
_no_gap = re.compile(r"[ \t\n\r]*\[[ \t\n\r]*\][ \t\n\r]*").fullmatch


def _levels(text: str, inside: bool) -> tuple[bool, int, dict[int, int]]:
    """(whether its end is inside a string, change of depth, objects that end at each depth) of a text, which begins inside a string or not."""
    at, depth, ended = 0, 0, Counter()
    if inside:
        m = _string_end(text, 0)
        if not m[1]:
            return True, 0, {}
        at = m.end()
    while stop := (m := _bracket(text, at))[1]:
        if stop == '"':
            return True, depth, ended
        at = m.end()
        depth += 1 if stop in "[{" else -1
        if stop == "}":
            ended[depth] += 1
    return False, depth, ended


def _object_end(text: str, state: tuple[bool, int], at: int = 0) -> tuple[int | None, tuple[bool, int]]:
    """(place after the first object that ends at depth 1, or None; the state there or at the end: inside a string, depth)."""
    inside, depth = state
    if inside:
        m = _string_end(text, at)
        if not m[1]:
            return None, state
        at = m.end()
    while stop := (m := _bracket(text, at))[1]:
        if stop == '"':
            return None, (True, depth)
        at = m.end()
        depth += 1 if stop in "[{" else -1
        if stop == "}" and depth == 1:
            return at, (False, 1)
    return None, (False, depth)


def _element(text: str, n: int) -> dict:
    _check_depth(text, 1)
    try:
        return _decoder.decode(text)
    except json.JSONDecodeError as e:
        raise Refused(f"not JSON: {e.msg} at {e.pos} of record {n + 1}") from None


def _wrong_gap(gap: str, n: int) -> Refused:
    return Refused(f"not JSON, or record {n + 1} is no object: {gap.strip()[:40]!r}")


def _array_plan(spark: SparkSession, path: str, encoding: str | None):
    """(pieces, plan, tails) of files that are arrays of objects, or None. A split's plan: its state at the start, the records
    begun before it, whether it is the file's last, and whether the separator after its last piece is none of the file's."""
    pieces = splits.pieces(spark, path, "}")

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in splits.stretches(batches, b"}"):
            seen, first, starts = splits.Bytes(), None, (False, True) if key[1] else (False,)
            out = {i: [i, 0, Counter()] for i in starts}
            for size, raw in parts:
                text = seen.text(key, size, raw)
                if first is None:
                    first = text.lstrip(" \t\n\r")[:1]
                levels = {i: _levels(text, i) for i in {o[0] for o in out.values()}}
                for o in out.values():
                    inside, change, ended = levels[o[0]]
                    for depth, n in ended.items():
                        o[2][o[1] + depth] += n
                    o[0], o[1] = inside, o[1] + change
            found = {**seen.found(), "first": first, "out": [[i, d, list(e.items())] for i, d, e in out.values()]}
            yield pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "found": json.dumps(found)}], pa.schema([("file", pa.string()), ("start", pa.int64()), ("found", pa.string())]))

    found = splits.by_file([{"file": r["file"], "start": r["start"], **json.loads(r["found"])} for r in pieces.mapInArrow(survey, "file string, start long, found string").collect()])
    if any(encoding is None and s["mark"] for parts in found.values() for s in parts) or any(parts[0]["start"] or parts[0]["first"] != "[" for parts in found.values()):
        return None
    plan: dict[splits.Key, tuple] = {}
    cut: dict[splits.Key, tuple[bool, int]] = {}
    for file, parts in found.items():
        ends = splits.checked(parts)
        inside, depth, done = False, 0, 0
        for s in parts:
            key, last = (file, s["start"]), s is parts[-1]
            middle = inside or depth > 1
            if middle:
                cut[key] = (inside, depth)
            plan[key] = ((inside, depth), done + middle, last, last and not ends)
            after, change, ended = s["out"][inside]
            done += dict(map(tuple, ended)).get(1 - depth, 0)
            inside, depth = after, depth + change
        if inside or depth != (0 if ends else -1):
            return None  # no JSON: the reader of whole files says where
    heads = splits.heads(pieces, b"}", cut, _object_end)
    return None if heads is None else (pieces, plan, splits.tails({file: [(file, s["start"]) for s in parts] for file, parts in found.items()}, heads))


def _array_records(batches: Iterator[pa.RecordBatch], plan: dict, tails: dict) -> Iterator[tuple[splits.Key, int, list[dict[str, str]]]]:
    """(split, number of the first record, records) of each stretch."""
    for key, parts in splits.stretches(batches, b"}"):
        state, n, last, extra = splits.of(plan, key)
        middle, held, begin, parts = state[0] or state[1] > 1, "", 0, iter(parts)
        seen, (_, raw) = 0, next(parts)
        while raw is not None:
            _, after = next(parts, (0, None))
            text = raw.decode()
            if extra and after is None:
                text = text[:-1]
            raw = after
            begin = 0
            if middle:
                begin, state = _object_end(text, state)
                if begin is None:
                    continue
                middle = False
            seen, records, base, held = len(held), [], begin, held + text
            at, place = base, seen if seen else begin
            while True:
                place, state = _object_end(held, state, place)
                if place is None:
                    break
                start = held.find("{", at, place)
                if not (_gap if n else _first_gap)(gap := held[at:start]):
                    raise _wrong_gap(gap, n)
                records.append({k: cell(v) for k, v in _element(held[start:place], n).items()})
                at, n = place, n + 1
            held = held[at:]
            yield key, n - len(records), records
        if last and not middle and not (_last_gap if n else _no_gap)(held):
            raise _wrong_gap(held, n)
        if not last and held:
            start = held.find("{")
            if start < 0 or not (_gap if n else _first_gap)(held[:start]):
                raise _wrong_gap(held[: start if start >= 0 else None], n)
            yield key, n, [{k: cell(v) for k, v in _element(held[start:] + tails.get(key, ""), n).items()}]


def _lines_plan(spark: SparkSession, path: str, encoding: str | None):
    """(pieces, (records, lines) before each split, names) of files of JSON Lines, or None."""
    pieces = splits.pieces(spark, path, "\n")

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in splits.stretches(batches, b"\n"):
            seen, names, records, at, wrong = splits.Bytes(), {}, 0, 0, None
            for size, raw in parts:
                text = seen.text(key, size, raw)
                if wrong or seen.mark:
                    continue
                for at, line in enumerate(text.split("\n")[:-1], at + 1):
                    if line.strip():
                        try:
                            record = parsed(line)
                            if not isinstance(record, dict):
                                raise Refused("is no object")
                        except Refused as e:
                            wrong = str(e)
                            break
                        names.update(dict.fromkeys(record))
                        records += 1
            found = {**seen.found(), "records": records, "lines": at, "refused": wrong, "names": list(names)}
            yield pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "found": json.dumps(found)}], pa.schema([("file", pa.string()), ("start", pa.int64()), ("found", pa.string())]))

    found = splits.by_file([{"file": r["file"], "start": r["start"], **json.loads(r["found"])} for r in pieces.mapInArrow(survey, "file string, start long, found string").collect()])
    if encoding is None and any(s["mark"] for parts in found.values() for s in parts):
        return None
    before, names = {}, {}
    for file, parts in found.items():
        splits.checked(parts)
        records = lines = 0
        for s in parts:
            before[file, s["start"]] = records
            if s["refused"]:
                raise Refused(f"line {lines + s['lines']} {s['refused']}" if s["refused"] == "is no object" else f"line {lines + s['lines']}: {s['refused']}")
            records, lines = records + s["records"], lines + s["lines"]
            names.update(dict.fromkeys(s["names"]))
    return pieces, before, list(names)


def _read_lines(spark: SparkSession, path: str, encoding: str | None) -> Table | None:
    """read_json of UTF-8 files of JSON Lines, by all tasks; None if they have to be read whole."""
    made = _lines_plan(spark, path, encoding)
    if made is None:
        return None
    pieces, before, names = made

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in splits.stretches(batches, b"\n"):
            at = splits.of(before, key)
            for _, raw in parts:
                records = list(rows(raw.decode(), True))
                for b in _batches(splits.plain_path(key[0]), at, records, names):
                    yield b
                at += len(records)

    return Table(pieces.mapInArrow(parse, _schema(names)), names)


def _read_arrays(spark: SparkSession, path: str, encoding: str | None) -> Table | None:
    """read_json of UTF-8 files that are arrays of objects, by all tasks; None if they have to be read whole."""
    made = _array_plan(spark, path, encoding)
    if made is None:
        return None
    pieces, plan, tails = made

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, found in groupby(_array_records(batches, plan, tails), key=lambda f: f[0]):
            names: dict[str, None] = {}
            for _, _, records in found:
                for r in records:
                    if not r.keys() <= names.keys():
                        names.update(dict.fromkeys(r))
            n = len(names)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(list(names), pa.string())], names=["file", "start", "at", "name"])

    found = pieces.mapInArrow(keys, "file string, start long, at long, name string").groupBy("name").agg(F.min(F.struct("file", "start", "at")).alias("first")).orderBy("first").collect()
    names = [r["name"] for r in found]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, at, records in _array_records(batches, plan, tails):
            for b in _batches(splits.plain_path(key[0]), at, records, names):
                yield b

    return Table(pieces.mapInArrow(parse, _schema(names)), names)


def _schema(names: list[str]) -> str:
    return ", ".join(["file string", "rid long", *(f"c{i} string" for i in range(len(names)))])


def _batches(file: str, at: int, records: list[dict[str, str]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(records), _BATCH):
        part = records[i : i + _BATCH]
        columns = [pa.array([r.get(k, "") for r in part], pa.string()) for k in names]
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(part), pa.string()), pa.array(range(at + i, at + i + len(part)), pa.int64()), *columns], names=["file", "rid", *(f"c{j}" for j in range(len(names)))])


def read_json(spark: SparkSession, path: str, lines: bool | None = None, encoding: str | None = None) -> Table:
    """The table of a JSON or JSON Lines file, or of a folder of them; lines: None takes it from the ending.

    UTF-8 files of lines or arrays are read by all tasks, objects of arrays and other encodings by one task each.
    """
    if lines is None:
        lines = path.lower().rstrip("/").endswith((".jsonl", ".ndjson"))
    packed = _files(spark, path).agg(F.max(F.lower("path").rlike(splits.PACKED + r"|\.(gz|bz2|zst)$"))).first()[0]  # no file is read for that
    if not packed and (encoding is None or codec_of(encoding) == "utf-8"):
        table = (_read_lines if lines else _read_arrays)(spark, path, encoding)
        if table is not None:
            return table
    return _read_whole(spark, path, lines, encoding)


def _read_whole(spark: SparkSession, path: str, lines: bool, encoding: str | None) -> Table:
    files = _files(spark, path)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content")):
                text = decoded(raw.as_py(), encoding)
                seen: dict[str, int] = {}
                if not lines and isinstance(document := parsed(text), dict):
                    seen = {k: i for i, k in enumerate(document)}  # a column form can have columns without rows
                else:
                    for record in rows(text, lines):
                        for k in record:
                            seen.setdefault(k, len(seen))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array(list(seen), pa.string())], names=["file", "at", "name"])

    found = files.mapInArrow(keys, "file string, at long, name string").groupBy("name").agg(F.min(F.struct("file", "at")).alias("first")).orderBy("first").collect()
    names = [r["name"] for r in found]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content")):
                records = list(rows(decoded(raw.as_py(), encoding), lines))
                columns = [pa.array([r.get(k, "") for r in records], pa.string()) for k in names]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(records), pa.string()), pa.array(range(len(records)), pa.int64()), *columns], names=["file", "rid", *(f"c{i}" for i in range(len(names)))])

    schema = ", ".join(["file string", "rid long", *(f"c{i} string" for i in range(len(names)))])
    return Table(files.mapInArrow(parse, schema), names)


def json_lines(df: DataFrame, names: list[str]) -> DataFrame:
    """line: each row as an object whose values are strings, in the order of names."""
    from quillon.functions.text import json_string

    parts: list = []
    for i, n in enumerate(names):
        parts += [F.lit((", " if i else "{") + quoted(n) + ": "), json_string(F.col(f"c{i}"))]
    return df.select("file", "rid", F.concat(*parts, F.lit("}")).alias("line"))
