"""Missing values and value labels of the statistics packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators._lineage import measured


def missing_range(value: Column, ranges: list[tuple[float, float]]) -> Column:
    """The number of the first range that holds the value, null if none does."""
    out = F.lit(None).cast("int")
    for i, (low, high) in reversed(list(enumerate(ranges))):
        out = F.when(value.between(low, high), F.lit(i)).otherwise(out)
    return out


def missing_tag(value: Column, ranges: list[tuple[float, float]], first: str = "a") -> Column:
    """The letter that stands for a user-missing value in a package with tags: one for each range."""
    at = missing_range(value, ranges)
    return F.when(at.isNotNull(), F.char(at + ord(first)))


def labelled(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """df with `label`: what the first label set row (key, label, nth) says of the column's value, null if nothing."""
    first = measured(labels.groupBy("key").agg(F.min_by("label", "nth").alias("label")), F.coalesce(F.octet_length("label"), F.lit(0)) + 32)
    return df.join(first, df[column] == first["key"], "left").drop("key")


def losses(df: DataFrame, column: str, ranges: list[tuple[float, float]], integral: bool = True, width: int = 8, text: str | None = None) -> DataFrame:
    """item, n: what a copy to a package without tags, fractions or longer strings would lose."""
    items = [("missing_tags", missing_range(F.col(column), ranges).isNotNull())]
    if integral:
        items.append(("fractions", F.col(column) != F.floor(F.col(column))))
    if text:
        items.append(("cut_strings", F.length(text) > width))
    counts = df.agg(*[F.count_if(c).alias(k) for k, c in items])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("item"), F.col(k).alias("n")) for k, _ in items])))
