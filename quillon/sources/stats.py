"""Files of statistics packages: one typed model of them, their text, and from one to another.

A file is parsed by the task that holds it. Numbers are doubles with a tag beside them (system
missing has the empty tag, tagged missing its letter); strings are text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.functions.dates import EPOCH_DAYS, kind_of
from quillon.functions.text import legal_name
from quillon.sources.bytes_in import Refused, format_of
from quillon.sources.delimited import Table, _files


@dataclass
class Variable:
    name: str
    text: bool = False
    width: int = 8
    label: str = ""
    shown: str = ""  # the display format
    labels: str = ""  # the name of its value labels
    missing: list[tuple[float, float]] = field(default_factory=list)  # user-missing ranges
    single: bool = False  # stored as a float of 32 bits


@dataclass
class Dataset:
    family: str
    variables: list[Variable]
    columns: list  # per variable: list of str, or (float64 array, list of tags: None, "" or a letter)
    label: str = ""
    sets: dict[str, dict[float, str]] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return 0 if not self.columns else len(self.columns[0] if self.variables[0].text else self.columns[0][1])

    def schema(self) -> str:
        """Everything but the rows, as JSON."""
        sets = {k: {shortest(v): t for v, t in s.items()} for k, s in self.sets.items()}
        return json.dumps({"family": self.family, "label": self.label, "rows": self.rows, "variables": [asdict(v) for v in self.variables], "sets": sets, "notes": self.notes}, ensure_ascii=True)


def shortest(x: float) -> str:
    """The shortest text that reads back as the double; whole numbers below 1e15 without a point."""
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    return str(int(x)) if x == math.floor(x) and abs(x) < 1e15 else repr(x)


def shortest_single(x: float) -> str:
    """The text of 6 to 9 digits that reads back as the float of 32 bits."""
    if x and math.isfinite(x):
        for digits in range(6, 10):
            near = float(f"{x:.{digits}g}")
            if np.float32(near) == np.float32(x):
                return shortest(near)
    return shortest(x)


def _civil(days: float) -> str | None:
    if days != math.floor(days):
        return None
    try:
        return (date(1970, 1, 1) + timedelta(days=int(days))).isoformat()
    except OverflowError:
        return None


def shown(x: float, kind: str, family: str) -> str:
    """A number by its display format: an ISO date, date-time or time, or else the number itself."""
    units = 1000.0 if family == "stata" and kind in ("datetime", "time") else 1.0
    if kind == "date":
        days = x / 86400 if family == "spss" else x
        return _civil(days + EPOCH_DAYS[family]) or shortest(x)
    if kind in ("datetime", "time"):
        micros = x / units * 1e6
        if micros != math.floor(micros) or abs(micros) > 4e17:
            return shortest(x)
        day, rest = divmod(int(micros), 86_400_000_000) if kind == "datetime" else (0, int(micros))
        if rest < 0:
            return shortest(x)
        seconds, fraction = divmod(rest, 1_000_000)
        clock = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}" + (f".{fraction:06d}".rstrip("0") if fraction else "")
        if kind == "time":
            return clock
        start = _civil(day + EPOCH_DAYS[family])
        return f"{start} {clock}" if start else shortest(x)
    return shortest(x)


def rendered(data: Dataset) -> list[list[str]]:
    """The cells of each column: tagged missing as .a, system missing as nothing, dates by their format."""
    out = []
    for v, c in zip(data.variables, data.columns):
        if v.text:
            out.append(list(c))
            continue
        kind = kind_of(data.family, v.shown)
        text = shortest_single if v.single and kind not in ("date", "datetime", "time") else lambda x: shown(x, kind, data.family)
        out.append(["" if tag == "" else f".{tag}" if tag else text(x) if math.isfinite(x) else "" for x, tag in zip(c[0].tolist(), c[1])])
    return out


def losses(data: Dataset) -> list[tuple[str, int]]:
    """(what a copy as text loses, of how many columns or cells)."""
    found = {
        "variable labels": sum(bool(v.label) for v in data.variables),
        "value labels": sum(bool(v.labels) for v in data.variables),
        "user-missing ranges": sum(bool(v.missing) for v in data.variables),
        "display formats": sum(kind_of(data.family, v.shown) == "other" and bool(v.shown) for v in data.variables),
        "notes": len(data.notes),
        "file label": int(bool(data.label)),
    }
    return [(k, n) for k, n in found.items() if n]


#: What a destination can hold: longest name, longest label, longest string, tags, user-missing ranges.
CAPACITY = {"dta": (32, 80, 2045, True, False), "xpt": (32, 40, 32767, True, False), "sav": (64, 255, 32767, False, True), "zsav": (64, 255, 32767, False, True), "por": (8, 255, 255, False, True)}


def parser(kind: str):
    from quillon.sources import portable, sas7bdat, spss, stata, transport

    found = {"xpt": transport.parse, "dta": stata.parse, "sav": spss.parse, "zsav": spss.parse, "por": portable.parse, "sas7bdat": sas7bdat.parse}.get(kind)
    if found is None:
        raise Refused(f"{kind} files are not read yet")
    return found


def writer(kind: str):
    from quillon.sources import portable, sas7bdat, spss, stata, transport

    found = {"xpt": transport.written, "dta": stata.written, "sav": spss.written, "por": portable.written}.get(kind)
    if found is None:
        raise Refused(f"{kind} files are not written")
    return found


def translated(data: Dataset, kind: str) -> tuple[Dataset, list[tuple[str, int]]]:
    """The data as the destination can hold them, and what it cannot."""
    most_name, most_label, most_text, tags, ranges = CAPACITY[kind]
    family = {"dta": "stata", "xpt": "sas"}.get(kind, "spss")
    taken: set[str] = set()
    lost: dict[str, int] = {}

    def lose(what: str, n: int = 1) -> None:
        if n:
            lost[what] = lost.get(what, 0) + n

    variables, columns = [], []
    for v, c in zip(data.variables, data.columns):
        name = legal_name(v.name, taken, most_name)
        lose("names", name != v.name)
        lose("variable labels cut", len(v.label) > most_label)
        own = Variable(name, v.text, v.width, v.label[:most_label], "", v.labels, v.missing if ranges else [])
        if v.text:
            cut = [s if len(s.encode()) <= most_text else s.encode()[:most_text].decode(errors="ignore") for s in c]
            lose("strings cut", sum(a != b for a, b in zip(cut, c)))
            own.width = max([1, *(len(s.encode()) for s in cut)])
            columns.append(cut)
        else:
            x, tag = c[0].copy(), list(c[1])
            kind_ = kind_of(data.family, v.shown)
            if kind_ in ("date", "datetime"):
                seconds = x * 86400 if kind_ == "date" and data.family != "spss" else x / (1000 if data.family == "stata" else 1)
                seconds = seconds + (EPOCH_DAYS[data.family] - EPOCH_DAYS[family]) * 86400.0
                x = seconds / 86400 if kind_ == "date" and family != "spss" else seconds * (1000 if family == "stata" else 1)
                own.shown = {"stata": {"date": "%td", "datetime": "%tc"}, "sas": {"date": "DATE9", "datetime": "DATETIME20"}, "spss": {"date": "DATE11", "datetime": "DATETIME20"}}[family][kind_]
            if not ranges:
                for i, (low, high) in enumerate(v.missing):
                    inside = np.flatnonzero((x >= low) & (x <= high) & np.array([t is None for t in tag], bool))
                    for r in inside.tolist():
                        tag[r] = chr(ord("a") + i)
            if not tags:
                lose("missing tags", sum(bool(t) for t in tag))
                tag = [None if t is None else "" for t in tag]
            columns.append((x, tag))
        variables.append(own)
    if kind == "xpt":
        lose("value labels", sum(bool(v.labels) for v in data.variables))
        lose("notes", len(data.notes))
    return Dataset(family, variables, columns, data.label, data.sets, data.notes), list(lost.items())


def same(a: Dataset, b: Dataset) -> bool:
    """Whether two data sets have the same names, cells and tags."""
    if [v.name for v in a.variables] != [v.name for v in b.variables]:
        return False
    for v, x, y in zip(a.variables, a.columns, b.columns):
        if v.text:
            if list(x) != list(y):
                return False
        else:
            here = [t is None for t in x[1]]
            if list(x[1]) != list(y[1]) or not np.array_equal(np.asarray(x[0])[here], np.asarray(y[0])[here]):
                return False
    return True


# -- on Spark -------------------------------------------------------------------------------


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """file, schema: what each file says of itself, as JSON."""
    parse = parser(format_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content")):
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([parse(raw.as_py()).schema()])], names=["file", "schema"])

    return _files(spark, path).mapInArrow(run, "file string, schema string")


def read_stats(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The typed rows (file, rid, then struct<v double, tag string> or string for each variable) and the schema."""
    first = read_schema(spark, path).orderBy("file").first()
    if first is None:
        raise Refused(f"there is no file at {path}")
    schema = json.loads(first["schema"])
    parse = parser(format_of(path))
    kinds = [v["text"] for v in schema["variables"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content")):
                data = parse(raw.as_py())
                arrays = [pa.array([file] * data.rows, pa.string()), pa.array(range(data.rows), pa.int64())]
                for v, c in zip(data.variables, data.columns):
                    arrays.append(pa.array(c, pa.string()) if v.text else pa.StructArray.from_arrays([pa.array([x if t is None else None for x, t in zip(c[0].tolist(), c[1])], pa.float64()), pa.array(c[1], pa.string())], names=["v", "tag"]))
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "rid", *(f"c{i}" for i in range(len(kinds)))])

    columns = ", ".join(["file string", "rid long", *(f"c{i} {'string' if t else 'struct<v: double, tag: string>'}" for i, t in enumerate(kinds))])
    return _files(spark, path).mapInArrow(run, columns), schema


def read_stats_text(spark: SparkSession, path: str) -> Table:
    """The table of a file's cells as text."""
    schema = json.loads(read_schema(spark, path).orderBy("file").first()["schema"])
    parse = parser(format_of(path))
    names = [v["name"] for v in schema["variables"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content")):
                data = parse(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([file] * data.rows, pa.string()), pa.array(range(data.rows), pa.int64()), *(pa.array(c, pa.string()) for c in rendered(data))], names=["file", "rid", *(f"c{i}" for i in range(len(names)))])

    columns = ", ".join(["file string", "rid long", *(f"c{i} string" for i in range(len(names)))])
    return Table(_files(spark, path).mapInArrow(run, columns), names, schema)


def count_stats(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, variables: what each file holds, without its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content")):
                data = parse(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([data.rows], pa.int64()), pa.array([len(data.variables)], pa.int64())], names=["file", "rows", "variables"])

    parse = parser(format_of(path))
    return _files(spark, path).mapInArrow(run, "file string, rows long, variables long")


def text_losses(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """What copies of the files as text lose, summed over them."""
    parse = parser(format_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content"):
                found = losses(parse(raw.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["item", "n"])

    from pyspark.sql import functions as F

    return [(r["item"], r["n"]) for r in _files(spark, path).mapInArrow(run, "item string, n long").groupBy("item").agg(F.sum("n").alias("n")).orderBy("item").collect()]


def translate(spark: SparkSession, source: str, kind: str) -> DataFrame:
    """file, data, lost: each file as one of another package, checked by reading it back, and what it lost as JSON."""
    parse, write, again = parser(format_of(source)), writer(kind), parser(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content")):
                own, lost = translated(parse(raw.as_py()), kind)
                out = write(own)
                if not same(own, again(out)):
                    raise ValueError(f"{file} did not come back as it was written")
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([out], pa.binary()), pa.array([json.dumps(dict(lost))])], names=["file", "data", "lost"])

    return _files(spark, source).mapInArrow(run, "file string, data binary, lost string")
