"""How many rows a block has, and what blocks come to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import numbers as N

#: A worker's own bytes, bytes of work for each byte of text and for each cell, and the least and most rows.
BASE, PER_BYTE, PER_CELL, LEAST, MOST = 160_000_000, 14, 64, 1_000, 2_000_000
SAMPLE_ROWS = 2000
VERIFY_SHARE = 0.35


def row_bytes(df: DataFrame, row: str) -> DataFrame:
    """avg_bytes, n_columns: the mean text of the first rows, each cell's separator included."""
    names = [c for c in df.columns if c != row]
    size = sum((F.octet_length(N.to_text(F.col(c), df.schema[c].dataType)) for c in names), F.lit(len(names)))
    return df.where(F.col(row) < SAMPLE_ROWS).agg(F.avg(size).alias("avg_bytes"), F.lit(len(names)).alias("n_columns"))


def planned_rows(sample: DataFrame, budget: int, workers: int, verify: bool = True) -> DataFrame:
    """rows_per_block that keeps `workers` blocks at work within `budget` bytes."""
    room = max(0, budget // workers - BASE)
    rows = F.lit(float(room)) / (PER_BYTE * F.col("avg_bytes") + PER_CELL * F.col("n_columns"))
    if not verify:
        rows = rows / (1 - VERIFY_SHARE)
    return sample.select("n_columns", F.greatest(F.least(F.floor(rows), F.lit(MOST)), F.lit(LEAST)).cast("long").alias("rows_per_block"))


def block_stats(sizes: DataFrame, size: str = "bytes") -> DataFrame:
    """n_blocks, least, middle (the upper of two) and most, counted in each task first."""
    middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{size}` DESC)")
    return sizes.agg(F.count(F.lit(1)).alias("n_blocks"), F.min(size).alias("least"), middle.cast(sizes.schema[size].dataType).alias("middle"), F.max(size).alias("most"))
