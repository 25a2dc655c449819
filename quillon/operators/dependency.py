"""Dictionaries, and how much the columns of a table tell about each other.

Entropies are doubles whose last bits depend on the order of a sum, so that decisions are
made on them quantised to multiples of 2^-20.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators._lineage import kept
from quillon.operators.profile import DICTIONARY_VALUES

LEAST_GAIN = 0.05
#: Rows that gains are estimated on, and grouping sets and columns of one pass.
SAMPLE_ROWS, BATCH_SETS, BATCH_COLUMNS = 20_000, 256, 48
_ONE = 1 << 20


def score(x: Column) -> Column:
    return F.floor(x * _ONE + 0.5).cast("long")


def alphabet(df: DataFrame, name: str, most: int = DICTIONARY_VALUES) -> DataFrame:
    """value, id, n: the distinct values in byte order, numbered from 0, and how often each occurs.

    A column with more than `most` values is no dictionary and is refused; so the one task that
    numbers them never gets more rows than that, whatever the column.
    """
    counts = df.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n")).limit(most + 1)
    place = (F.row_number().over(Window.orderBy("value")) - 1).cast("long")
    bounded = F.when(place >= most, F.raise_error(F.lit(f"{name} has more than {most} values")).cast("long")).otherwise(place)
    return counts.select("value", bounded.alias("id"), "n")


def encode(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """df with the value's id in place of the value; a value that the alphabet lacks has none."""
    return df.join(F.broadcast(values.select(F.col("value").alias("__v"), F.col("id").alias(f"{name}_id"))), df[name].eqNullSafe(F.col("__v")), "left").drop("__v", name)


def decode(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """The inverse of encode; an id outside the alphabet is an error, not a lost row."""
    joined = df.join(F.broadcast(values.select(F.col("id").alias("__i"), F.col("value").alias("__v"))), df[f"{name}_id"] == F.col("__i"), "left")
    checked = F.when(F.col("__i").isNull(), F.raise_error(F.lit("an id is not in the alphabet"))).otherwise(F.col("__v"))
    return joined.withColumn(name, checked).drop("__i", "__v", f"{name}_id")


def sampled(df: DataFrame, row: str, n: int | None = None) -> DataFrame:
    """Every k-th row by its number, so that SAMPLE_ROWS at least and less than twice as many are left; all rows of a
    table with fewer. What gains are estimated on does not grow with the table."""
    n = df.count() if n is None else n
    return df.where(F.col(row) % max(1, n // SAMPLE_ROWS) == 0)


def _batches(sets: list[tuple[str, ...]]) -> Iterator[tuple[list[str], list[tuple[str, ...]]]]:
    """The sets in batches of at most BATCH_SETS sets over at most BATCH_COLUMNS columns, which a grouping id has bits for."""
    names: list[str] = []
    part: list[tuple[str, ...]] = []
    for s in sets:
        more = [c for c in s if c not in names]
        if part and (len(part) == BATCH_SETS or len(names) + len(more) > BATCH_COLUMNS):
            yield names, part
            names, part, more = [], [], list(dict.fromkeys(s))
        names = names + more
        part.append(s)
    if part:
        yield names, part


def _set_entropies(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """x, y (null for a single column), n, n_distinct, h of each set of columns: a pass and a shuffle of
    counts by the columns' own types for each batch of sets. Nulls are a value like others."""
    out = None
    for names, part in _batches(sets):
        counts = df.select(*[F.col(f"`{c}`") for c in names]).groupingSets([[F.col(f"`{c}`") for c in s] for s in part], *[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("__k"), F.grouping_id().alias("__g"))
        # sum of -p log2 p = log2 n - (sum of k log2 k) / n
        n = F.sum("__k")
        by = counts.where("__k > 0").groupBy("__g").agg(n.alias("n"), F.count(F.lit(1)).alias("n_distinct"), (F.log2(n) - F.sum(F.col("__k") * F.log2("__k")) / n).alias("h"))
        bit = {c: 1 << (len(names) - 1 - i) for i, c in enumerate(names)}
        ids = df.sparkSession.createDataFrame([((1 << len(names)) - 1 - sum(bit[c] for c in s), s[0], s[1] if len(s) > 1 else None) for s in part], "__g long, x string, y string")
        found = by.join(F.broadcast(ids), "__g").select("x", "y", "n", "n_distinct", "h")
        if out is not None and len(sets) > BATCH_SETS:
            found = kept(found)  # many batches are many jobs, not one plan of all of them
        out = found if out is None else out.unionByName(found)
    return out


def column_entropies(df: DataFrame, names: list[str]) -> DataFrame:
    """col, n, n_distinct, h: the plug-in entropy of each column in bits."""
    return _set_entropies(df, [(c,) for c in names]).select(F.col("x").alias("col"), "n", "n_distinct", "h")


def _tiled(names: list[str]) -> Iterator[tuple[str, str]]:
    """All pairs, by tiles of columns, so that the pairs of a batch have few columns between them."""
    width = BATCH_COLUMNS // 2
    tiles = [names[i : i + width] for i in range(0, len(names), width)]
    for i, a in enumerate(tiles):
        yield from combinations(a, 2)
        for b in tiles[i + 1 :]:
            yield from product(a, b)


def gain_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """parent, child, gain_q of every ordered pair: H(child) - H(child | parent), where the conditional
    entropy is corrected for what few rows hide, by (joint values - parent values) / (2 n ln 2)."""
    # a row for each column and pair: few, and needed three times
    found = kept(_set_entropies(df, [*((c,) for c in names), *_tiled(names)]).coalesce(1))
    single, joint = found.where("y IS NULL").select(F.col("x").alias("col"), "n_distinct", "h"), found.where("y IS NOT NULL")
    both = joint.select(F.col("x").alias("parent"), F.col("y").alias("child"), "n", "n_distinct", "h").union(joint.select("y", "x", "n", "n_distinct", "h"))
    p = single.select(F.col("col").alias("parent"), F.col("h").alias("hp"), F.col("n_distinct").alias("np"))
    c = single.select(F.col("col").alias("child"), F.col("h").alias("hc"))
    given = F.col("h") - F.col("hp") + (F.col("n_distinct") - F.col("np")) / (2 * F.col("n") * F.log(F.lit(2.0)))
    return both.join(F.broadcast(p), "parent").join(F.broadcast(c), "child").select("parent", "child", (score(F.col("hc")) - score(given)).alias("gain_q"))


def best_parents(gains: DataFrame, most: int = 5) -> DataFrame:
    """child, rank, parent, gain_q: each column's best parents, equal gains by name."""
    order = Window.partitionBy("child").orderBy(F.desc("gain_q"), "parent")
    return gains.where(F.col("gain_q") > int(LEAST_GAIN * _ONE)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("child", "rank", "parent", "gain_q")


def parent_tree(entropies: dict[str, int], gains: dict[tuple[str, str], int], least: int = int(LEAST_GAIN * _ONE)) -> list[tuple[str, str | None]]:
    """(column, parent) in the order of placement.

    The column of least entropy is the first root. Then the unplaced column with the largest gain
    over the least one from a placed column is placed under it; where none has one, the unplaced
    column of least entropy becomes a root. Ties go to the smaller names.
    """
    placed: list[tuple[str, str | None]] = []
    free = set(entropies)
    while free:
        done = [c for c, _ in placed]
        offers = [(-gains.get((p, c), 0), c, p) for c in free for p in done if gains.get((p, c), 0) > least]
        if offers:
            _, child, parent = min(offers)
        else:
            child, parent = min(free, key=lambda c: (entropies[c], c)), None
        placed.append((child, parent))
        free.remove(child)
    return placed


def parents(df: DataFrame, names: list[str], row: str | None = None) -> list[tuple[str, str | None]]:
    """parent_tree of a table's columns; the driver holds one number for each pair of columns. With the column `row`,
    which numbers the rows, gains are estimated on a sample of them."""
    if row is not None:
        df = sampled(df, row)
    entropies = {r["col"]: r["q"] for r in column_entropies(df, names).select("col", score(F.col("h")).alias("q")).collect()}
    gains = {(r["parent"], r["child"]): r["gain_q"] for r in gain_matrix(df, names).collect()}
    return parent_tree(entropies, gains)
