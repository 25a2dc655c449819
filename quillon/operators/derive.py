"""Columns whose numbers are copied, or rounded, from other columns of the same row.

A sampled row offers each numeric cell and each of its roundings; the number tokens of the
other cells are looked up among them by (row, token). A column explains another if it does so
in at least half of the sampled rows in which the other has a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions.text import number_tokens
from quillon.operators.profile import rendered

SAMPLE_ROWS, MOST_SOURCES, MOST_ROUNDING = 500, 4, 6
#: The bytes around a reference in a rewritten cell.
OPEN, CLOSE = "\x01", "\x02"


def systematic_sample(df: DataFrame, row: str, step: int) -> DataFrame:
    return df.where(F.col(row) % step == 0)


def _cells(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    texts = df.select(F.col(row).alias("rid"), *[N.to_text(F.col(c), df.schema[c].dataType).alias(c) for c in names])
    return texts.select("rid", F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("col"), F.col(c).alias("cell")) for i, c in enumerate(names)])))


def derive_hits(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    """target, source, n_hit, n_seen: in how many rows a source's number, or a rounding of it, is a
    token of the target, and in how many rows the target has a number. An equality join on (row, token)."""
    cells = _cells(df, row, names)
    variants = F.array_distinct(F.array(F.col("cell"), *[N.round_half_even(F.col("cell"), d) for d in range(MOST_ROUNDING + 1)]))
    offers = cells.where(N.is_plain(F.col("cell"))).select("rid", F.col("position").alias("sp"), F.col("col").alias("source"), F.explode(variants).alias("token"))
    tokens = cells.select("rid", F.col("position").alias("tp"), F.col("col").alias("target"), F.explode(F.array_distinct(number_tokens(F.col("cell")))).alias("token"))
    seen = tokens.groupBy("target").agg(F.countDistinct("rid").alias("n_seen"))
    hits = tokens.join(offers, ["rid", "token"]).where("source <> target").groupBy("target", "source", "tp", "sp").agg(F.countDistinct("rid").alias("n_hit"))
    return hits.join(F.broadcast(seen), "target").select("target", "source", "n_hit", "n_seen", "tp", "sp")


def derive_candidates(hits: DataFrame) -> DataFrame:
    """target, source of columns that explain at least half of what the target has."""
    return hits.where(2 * F.col("n_hit") >= F.col("n_seen")).select("target", "source", "n_hit", "n_seen", "tp", "sp")


def derive_plan(df: DataFrame, row: str, names: list[str], rows: int | None = None) -> dict[str, list[str]]:
    """target: its sources, left to right, at most MOST_SOURCES; a source is never derived itself.

    The driver holds a row for each pair of columns at most.
    """
    n = rows if rows is not None else df.count()
    pairs = derive_candidates(derive_hits(systematic_sample(df, row, max(1, n // SAMPLE_ROWS)), row, names)).collect()
    plan: dict[str, list[str]] = {}
    used: set[str] = set()
    for target in sorted({(r["tp"], r["target"]) for r in pairs}):
        if target[1] in used:
            continue
        sources = [r["source"] for r in sorted((r for r in pairs if r["target"] == target[1] and r["source"] not in plan), key=lambda r: r["sp"])][:MOST_SOURCES]
        if sources:
            plan[target[1]] = sources
            used.update(sources)
    return plan


def _round(text: str, places: int) -> str | None:
    from decimal import ROUND_HALF_EVEN, Context, Decimal

    whole, _, rest = text.lstrip("-").partition(".")
    if len(rest) <= places:
        return None
    sign = "-" if text.startswith("-") else ""
    value = Decimal(f"{whole}.{rest}").quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN, Context(prec=len(whole) + len(rest) + 2))
    return sign + format(value, "f").rjust(len(whole) + (places + 1 if places else 0), "0")


def rewrite_cell(cell: str, sources: list[str]) -> str:
    """The cell with each number token that a source gives as a reference: a copy of source k as
    OPEN k: CLOSE, its rounding to d decimals as OPEN k:d CLOSE; copies come first, other tokens stay."""
    import re

    def refer(match) -> str:
        token = match.group()
        for k, s in enumerate(sources):
            if s == token:
                return f"{OPEN}{k}:{CLOSE}"
        places = len(token.partition(".")[2])
        for k, s in enumerate(sources):
            if re.fullmatch(N.PLAIN, s) and _round(s, places) == token:
                return f"{OPEN}{k}:{places}{CLOSE}"
        return token

    return re.sub(N.TOKEN, refer, cell)


def expand_cell(cell: str, sources: list[str]) -> str:
    """The inverse of rewrite_cell; a malformed reference is an error."""
    import re

    def value(match) -> str:
        k, places = match.group(1), match.group(2)
        if int(k) >= len(sources):
            raise ValueError("a reference names no source")
        out = sources[int(k)] if places == "" else _round(sources[int(k)], int(places))
        if out is None:
            raise ValueError("a reference rounds to more decimals than there are")
        return out

    out = re.sub(f"{OPEN}([0-9]):([0-9]*){CLOSE}", value, cell)
    if OPEN in out or CLOSE in out:
        raise ValueError("a reference is malformed")
    return out


def _mapped(df: DataFrame, plan: dict[str, list[str]], work) -> DataFrame:
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b.column(c) for c in names}
            for target, sources in plan.items():
                lists = [columns[s].to_pylist() for s in sources]
                columns[target] = pa.array([work(cell, list(row)) for cell, *row in zip(columns[target].to_pylist(), *lists)], pa.string())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return df.mapInArrow(run, df.schema)


def derive(df: DataFrame, plan: dict[str, list[str]]) -> DataFrame:
    """df (text columns, none with a marker byte in a target) with the plan's targets rewritten."""
    return _mapped(df, plan, rewrite_cell)


def underive(df: DataFrame, plan: dict[str, list[str]]) -> DataFrame:
    return _mapped(df, plan, expand_cell)


def derivable(df: DataFrame) -> list[str]:
    """Columns without a marker byte."""
    texts = rendered(df)
    flags = texts.agg(*[F.coalesce(F.bool_or(F.col(c).contains(OPEN) | F.col(c).contains(CLOSE)), F.lit(False)).alias(c) for c in texts.columns]).first()
    return [c for c in texts.columns if not flags[c]]
