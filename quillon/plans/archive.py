"""Archives: a table's blocks as rows of Parquet, each encoded, decoded again and compared in one task."""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans import codec
from quillon.sources.delimited import Table

ROWS_PER_BLOCK = 100_000


def encode(table: Table, rows_per_block: int = ROWS_PER_BLOCK, verify: bool = True) -> DataFrame:
    """file, block, n_rows, n_bytes, data: the table's blocks. A row's block follows from its number, so
    that a file's rows meet by hash and no order of the whole table is needed."""
    names = table.names
    columns = [f"c{i}" for i in range(len(names))]

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("rid")
        cells = [group.column(c).to_pylist() for c in columns]
        data = codec.encode_block(names, cells)
        if verify and codec.decode_block(data) != (names, cells):
            raise codec.Damaged("a block did not come back as it was")
        return pa.table({"file": group.column("file")[:1], "block": group.column("block")[:1], "n_rows": pa.array([group.num_rows], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    blocks = table.rows.select("file", "rid", F.floor(F.col("rid") / rows_per_block).cast("long").alias("block"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])
    return blocks.groupBy("file", "block").applyInArrow(pack, "file string, block long, n_rows long, n_bytes long, data binary")


def decode(blocks: DataFrame, names: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> Table:
    """The table of an archive's blocks; a block whose columns are not the archive's is refused."""
    columns = [f"c{i}" for i in range(len(names))]

    def unpack(batches):
        for b in batches:
            for file, block, n, data in zip(*(b.column(c).to_pylist() for c in ("file", "block", "n_rows", "data"))):
                own, cells = codec.decode_block(data)
                if own != names or any(len(c) != n for c in cells):
                    raise codec.Damaged("a block is not of this archive")
                first = block * rows_per_block
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), *(pa.array(c, pa.string()) for c in cells)], names=["file", "rid", *columns])

    schema = ", ".join(["file string", "rid long", *(f"{c} string" for c in columns)])
    return Table(blocks.select("file", "block", "n_rows", "data").mapInArrow(unpack, schema), names)


def write_archive(table: Table, path: str, rows_per_block: int = ROWS_PER_BLOCK, verify: bool = True) -> None:
    """blocks/ and, last, plan/ with the names: an archive without a plan is not finished."""
    spark = table.rows.sparkSession
    encode(table, rows_per_block, verify).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    write_plan(spark, path, table.names, rows_per_block)


def write_plan(spark: SparkSession, path: str, names: list[str], rows_per_block: int) -> None:
    """What reading needs beside the blocks; one that is there already must say the same."""
    plan = {"v": codec.VERSION, "names": names, "rows_per_block": rows_per_block}
    try:
        own = _plan(spark, path)
    except AnalysisException:  # there is none
        spark.createDataFrame([(json.dumps(plan),)], "plan string").coalesce(1).write.parquet(f"{path}/plan")
        return
    if own != plan:
        raise codec.Damaged(f"the archive at {path} has other columns or blocks")


def _plan(spark: SparkSession, path: str) -> dict:
    plan = json.loads(spark.read.parquet(f"{path}/plan").first()["plan"])
    if plan["v"] > codec.VERSION:
        raise codec.Damaged("the archive is of a later version")
    return plan


def read_archive(spark: SparkSession, path: str) -> Table:
    plan = _plan(spark, path)
    return decode(spark.read.parquet(f"{path}/blocks"), plan["names"], plan["rows_per_block"])


def info(spark: SparkSession, path: str) -> dict:
    """Names, rows, blocks, bytes and the kinds that columns have, by blocks. Only the blocks' plans are decoded."""
    plan = _plan(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    total = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_rows").alias("rows"), F.sum("n_bytes").alias("bytes"), F.min("n_bytes").alias("least"), F.max("n_bytes").alias("most")).first()

    def kinds(batches):
        for b in batches:
            found = Counter((c, k["kind"]) for data in b.column("data").to_pylist() for c, k in enumerate(codec.plan_of(data)["columns"]))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["c", "kind", "n"])

    by = blocks.select("data").mapInArrow(kinds, "c int, kind string, n long").groupBy("c", "kind").agg(F.sum("n").alias("n")).collect()
    return {"names": plan["names"], **total.asDict(), "kinds": {plan["names"][r["c"]]: r["kind"] for r in sorted(by, key=lambda r: (r["c"], r["n"]))}}
