"""Operators on ordered rows. Order is explicit: a block column and a row number within it.

Windows are partitioned by block, so that no task orders more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.operators._lineage import kept

BLOCK, ROW = "block", "rid"
MOST_ORDER = 4


def numbered(df: DataFrame, *order: str, rows_per_block: int = 4096) -> DataFrame:
    """df with rid, the row's number from 0 by `order`, and block.

    Rows are sorted by ranges and counted per partition; only the partitions' counts are summed
    in one place. `order` must tell all rows apart for the numbers to be defined.
    """
    tagged = kept(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    counts = tagged.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    rid = F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return with_blocks(tagged.withColumn("__p", part).join(F.broadcast(base), "__p").withColumn(ROW, rid).drop("__m", "__p", "__b"), rows_per_block)


def with_blocks(df: DataFrame, rows_per_block: int) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(ROW) / rows_per_block).cast("long"))


def dealt(df: DataFrame, most: int = 5000) -> DataFrame:
    """df with whole blocks dealt evenly, one to a task up to `most` blocks, for work by blocks that costs more than its rows
    weigh: hashes would give some tasks several blocks and others none, and few tasks if the bytes are few."""
    n = df.select(BLOCK).distinct().count()
    return df.repartitionByRange(max(1, min(2 * n, 2 * most)), BLOCK)  # bounds closer than blocks, so that sampling joins none


def _w(*order: str):
    return Window.partitionBy(BLOCK).orderBy(*(order or (ROW,)))


def argsort(df: DataFrame, key: str) -> DataFrame:
    """block, pos, rid: the row at each place of the stable order by key."""
    return df.select(BLOCK, (F.row_number().over(_w(key, ROW)) - 1).cast("long").alias("pos"), ROW)


def inverse(permutation: DataFrame) -> DataFrame:
    """block, rid, pos: where each row went. Rows of a block are numbered from the block's first."""
    return permutation.select(BLOCK, ROW, "pos")


def differences(df: DataFrame, value: str, k: int) -> Column:
    """The k-th finite difference along the block, modulo 2^64; values before the block's first are 0."""
    w = _w()
    total = F.lit(0).cast("decimal(38,0)")
    binomial, sign = 1, 1
    for j in range(k + 1):
        total = total + F.coalesce(F.lag(value, j).over(w) if j else F.col(value), F.lit(0).cast("long")).cast("decimal(38,0)") * (sign * binomial)
        binomial, sign = binomial * (k - j) // (j + 1), -sign
    return wrapped(total)


def wrapped(x: Column) -> Column:
    """A whole decimal modulo 2^64, as a signed long."""
    span = F.lit(str(1 << 64)).cast("decimal(38,0)")
    low = F.pmod(x, span)
    return F.when(low >= F.lit(str(1 << 63)).cast("decimal(38,0)"), low - span).otherwise(low).cast("long")


def with_differences(df: DataFrame, value: str, most: int = MOST_ORDER) -> DataFrame:
    """block, rid, value and d1 to d`most`."""
    return df.select(BLOCK, ROW, F.col(value).alias("value"), *[differences(df, value, k).alias(f"d{k}") for k in range(1, most + 1)])


def undifferenced(df: DataFrame, value: str, k: int) -> DataFrame:
    """df with `value` summed up k times along the block: the inverse of the k-th difference."""
    w = _w().rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(k):
        df = df.withColumn(value, wrapped(F.sum(F.col(value).cast("decimal(38,0)")).over(w)))
    return df


def order_costs(df: DataFrame, value: str, most: int = MOST_ORDER) -> DataFrame:
    """block, k, bytes: the packed size of the k-th difference's zigzag codes and 8 for each of its k first values."""
    d = with_differences(df, value, most).select(BLOCK, F.inline(F.array(*[F.struct(F.lit(k).alias("k"), N.zigzag(F.col(f"d{k}" if k else "value")).alias("u")) for k in range(most + 1)])))
    return d.groupBy(BLOCK, "k").agg((N.packed_bytes(F.col("u")) + 8 * F.first("k")).alias("bytes"))


def chosen_order(costs: DataFrame) -> DataFrame:
    """block, k, bytes: the cheapest order of each block, the smallest of equals."""
    return costs.groupBy(BLOCK).agg(F.min(F.struct("bytes", "k")).alias("m")).select(BLOCK, "m.k", "m.bytes")


def gaps(df: DataFrame) -> Column:
    """The distance of each kept row to the one before it in its block, the first from the block's start."""
    return F.col("place") - F.coalesce(F.lag("place").over(_w("place")), F.lit(0))


def filled(df: DataFrame, value: str) -> Column:
    """Nulls take the last value before them in the block, leading ones the first after them."""
    w = _w()
    return F.coalesce(F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(value, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def double_differences(df: DataFrame, names: list[str]) -> DataFrame:
    """block, rid and each column's row difference minus that of the column before it; the first row stays."""
    w = _w()
    change = {c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in names}
    first = F.row_number().over(w) == 1
    out = [change[c] if i == 0 else F.when(first, F.col(c)).otherwise(change[c] - change[names[i - 1]]) for i, c in enumerate(names)]
    return df.select(BLOCK, ROW, *[x.alias(c) for x, c in zip(out, names)])


def undo_double_differences(df: DataFrame, names: list[str]) -> DataFrame:
    w = _w()
    first = F.row_number().over(w) == 1
    level = df.select(BLOCK, ROW, *names, first.alias("__first"))
    across = []
    for i, c in enumerate(names):
        across.append(F.when(F.col("__first"), F.col(c)).otherwise(sum((F.col(x) for x in names[:i]), F.col(c))).alias(c))
    level = level.select(BLOCK, ROW, *across)
    return level.select(BLOCK, ROW, *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in names])


def common_prefix(df: DataFrame, word: str, most: int = 255) -> Column:
    """Characters that each word shares with the one before it in the block's order of words, at most `most`."""
    before = F.coalesce(F.lag(word).over(_w(word)), F.lit(""))
    shorter = F.least(F.length(before), F.length(word), F.lit(most))
    equal = F.transform(F.sequence(F.lit(1), shorter), lambda i: F.when(F.substring(F.col(word), i, F.lit(1)) == F.substring(before, i, F.lit(1)), F.lit(0)).otherwise(i))
    return F.when(shorter == 0, F.lit(0)).otherwise(F.coalesce(F.array_min(F.filter(equal, lambda i: i > 0)) - 1, shorter))
