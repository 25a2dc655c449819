"""Lineage cuts in the folder that all executors share, and joins that broadcast only what was measured."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side whose rows were measured below this many bytes is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 24_000_000
#: A key of more rows than this is not looked up in one task; where it can't be broadcast, its row is copied so often.
HEAVY_ROWS, SALTS = 256, 64


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in spark.checkpoint.dir. Where that is unset, a local folder serves a local
    session, whose executors all see it; a cluster must set it."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def _total(df: DataFrame, row_bytes) -> int:
    return df.agg(F.sum(F.lit(0).cast("long") + row_bytes)).first()[0] or 0


def measured(df: DataFrame, row_bytes) -> DataFrame:
    """df with a broadcast hint if its rows come to at most BROADCAST_BYTES, else df itself.

    df must be cheap to read again (checkpointed); row_bytes is a column that bounds a row's size.
    """
    return F.broadcast(df) if _total(df, row_bytes) <= BROADCAST_BYTES else df


def looked_up(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame, row_bytes, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row for each key, so that no key's rows meet in one task.

    heavy: the keys of more than HEAVY_ROWS rows, checkpointed and unique. Their rows of the table are broadcast if
    that is small enough, else copied SALTS times and met with rows dealt over the copies. All other rows are
    joined by their key. how: inner or left.
    """
    size = _total(heavy, row_bytes)
    if not size:
        return rows.join(table, key, how)
    hot = table.join(heavy.select(key, F.lit(True).alias("__heavy")), key, "right")
    if size <= BROADCAST_BYTES:
        dealt = rows.join(F.broadcast(checkpointed(hot)), key, "left")
    else:
        copied = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(copied, [key, "__salt"], "left").drop("__salt")
    names = [c for c in table.columns if c != key]
    met = dealt.where("__heavy").drop("__heavy")
    if how == "inner":
        met = met.where(F.col(names[0]).isNotNull())
    return met.unionByName(dealt.where("__heavy IS NULL").select(*rows.columns).join(table, key, how))


def heavy_keys(rows: DataFrame, key: Column | str, name: str) -> DataFrame:
    """The keys of more than HEAVY_ROWS rows as column `name`, checkpointed; counted in each task first."""
    return checkpointed(rows.groupBy(F.col(key).alias(name) if isinstance(key, str) else key.alias(name)).count().where(F.col("count") > HEAVY_ROWS).select(name))
