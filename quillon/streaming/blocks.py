"""An archive that grows: rows of a stream are encoded block by block, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions import numbers as N
from quillon.plans.archive import encode, write_plan
from quillon.sources.delimited import Table


def archive_stream(stream: DataFrame, path: str, checkpoint: str, rows_per_block: int = 100_000) -> StreamingQuery:
    """Starts a query that takes what is there and writes each micro-batch's rows as blocks of `path`/blocks.

    Order within a micro-batch is that of the source's partitions; `file` names the micro-batch.
    A batch that runs again replaces what it wrote before. The plan is written first, since a stream has no end: what
    read_archive finds at any time are the blocks of the batches that are done. A stream with other columns, or other
    rows per block, than the archive has is refused.
    """
    names = stream.columns
    write_plan(stream.sparkSession, path, names, rows_per_block)
    kinds = {f.name: f.dataType for f in stream.schema.fields}

    def write(batch: DataFrame, number: int) -> None:
        part = F.spark_partition_id()
        rows = batch.select(F.concat(F.lit(f"{number:012d}-"), F.lpad(part.cast("string"), 6, "0")).alias("file"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("rid"), *[N.to_text(F.col(f"`{c}`"), kinds[c]).alias(f"c{i}") for i, c in enumerate(names)])
        encode(Table(rows, names), rows_per_block).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
