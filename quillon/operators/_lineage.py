"""Tables that must not change between two reads of them, and joins that broadcast only what was measured."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side whose rows were measured below this many bytes is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 24_000_000


def _folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-"))


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, in the folder that spark.checkpoint.dir names. Where that is unset, a local folder serves a
    local session, whose executors all see it; a cluster must set it."""
    _folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new path in that folder."""
    _folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def measured(df: DataFrame, row_bytes) -> DataFrame:
    """df, kept, with a broadcast hint if its rows come to at most BROADCAST_BYTES; row_bytes bounds a row's size."""
    df = kept(df)
    total = df.agg(F.sum(F.lit(0).cast("long") + row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
