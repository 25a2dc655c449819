"""Whether two tables are equal cell by cell, and numeric columns that could share a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """row, side (left, right or both): rows that one table lacks or that differ in a cell; nulls are equal."""
    if left.columns != right.columns:
        raise ValueError("the tables' columns differ")
    names = [c for c in left.columns if c != row]
    a = left.select(F.col(row), F.struct(*names).alias("__a"))
    b = right.select(F.col(row), F.struct(*names).alias("__b"))
    both = a.join(b, row, "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return both.select(row, F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right").otherwise("both").alias("side"))


def commensurable(a: int, b: int) -> bool:
    """Whether neither of two largest values is more than 8 times the other; 0 counts as 1."""
    a, b = max(a, 1), max(b, 1)
    return -(-a // 8) <= b and -(-b // 8) <= a


def groups(columns: list[tuple[str, str, int | None, int | None, bool]], least: int = 3) -> list[list[str]]:
    """Maximal runs of adjacent (name, kind, decimals, largest value, has a parent) numeric columns
    without a parent, of one number of decimals, each commensurable with the one before it."""
    found: list[list[str]] = []
    run: list[tuple[str, int, int]] = []
    for name, kind, dec, top, has_parent in [*columns, ("", "", None, None, True)]:
        fits = kind == "NUM" and not has_parent
        if run and not (fits and dec == run[-1][1] and commensurable(top, run[-1][2])):
            if len(run) >= least:
                found.append([r[0] for r in run])
            run = []
        if fits:
            run.append((name, dec, top))
    return found


def pairs(tops: DataFrame) -> DataFrame:
    """a, b of every two columns (col, dec, max_abs) that are commensurable. A row for each column: few."""
    one = F.greatest(F.col("max_abs"), F.lit(1).cast("long"))
    x = tops.select(F.col("col").alias("a"), F.col("dec").alias("da"), one.alias("ta"))
    y = tops.select(F.col("col").alias("b"), F.col("dec").alias("db"), one.alias("tb"))
    return x.join(F.broadcast(y), (F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))).where("(ta + 7) div 8 <= tb AND (tb + 7) div 8 <= ta").select("a", "b")
