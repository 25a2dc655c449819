"""Tables as delimited text, JSON and JSON Lines, and Parquet; and any table by its path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions.text import delimited_field
from quillon.sources.bytes_in import Refused, format_of
from quillon.sources.delimited import DELIMITER_OF, Table, read_delimited
from quillon.sources.json_rows import json_lines, quoted, read_json
from quillon.sources.stats import read_stats_text


def read_table(spark: SparkSession, path: str, encoding: str | None = None) -> Table:
    """The table at a path, by its ending."""
    kind = format_of(path)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, kind == "jsonl", encoding)
    if kind == "parquet":
        df = spark.read.parquet(path)
        rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("rid"), *[N.to_text(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
        return Table(rows, df.columns)
    if kind in ("xpt", "dta", "sav", "zsav", "por", "sas7bdat"):
        return read_stats_text(spark, path)
    return read_delimited(spark, path, encoding=encoding)


def _put(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """The lines, in order, as one file that appears at once: written beside the target, then renamed.

    The order is Spark's range sort; parts are joined by the file system in one pass over their bytes.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    folder = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    try:
        lines.write.option("lineSep", "\n").text(folder.toString())
        parts = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        whole = jvm.org.apache.hadoop.fs.Path(folder, "whole")
        out = fs.create(whole)
        for p in parts:
            read = fs.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
            read.close()
        out.close()
        # over a file that is there: it is the old one or the new one at any time
        replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf).rename(fs.makeQualified(whole), fs.makeQualified(target), replace)
    finally:
        fs.delete(folder, True)


def _ordered(first: list[str], body: DataFrame, last: list[str] = ()) -> DataFrame:
    spark = body.sparkSession
    edge = lambda rows, at: spark.createDataFrame([(at, "", i, x) for i, x in enumerate(rows)], "part int, file string, rid long, line string")
    out = body.select(F.lit(1).alias("part"), "file", "rid", "line")
    return edge(first, 0).union(out).union(edge(last, 2)).orderBy("part", "file", "rid").select("line")


def write_delimited(table: Table, path: str, delimiter: str | None = None) -> None:
    """A header and the rows, each ended by LF; a field is quoted only where it must be."""
    d = delimiter or DELIMITER_OF.get(format_of(path), ",")
    plain = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in (d, '"', "\r", "\n")) else s
    cells = [delimited_field(F.col(f"c{i}"), d) for i in range(len(table.names))]
    body = table.rows.select("file", "rid", F.concat_ws(d, *cells).alias("line"))
    _put(table.rows.sparkSession, _ordered([d.join(map(plain, table.names))] if table.names else [], body), path)


def _distinct_names(table: Table) -> None:
    twice = {n for n in table.names if table.names.count(n) > 1}
    if twice:
        raise Refused(f"two columns are named {sorted(twice)[0]!r}; an object can have only one")


def write_json(table: Table, path: str) -> None:
    """An array of an object for each row, every value a string; without rows, an object of empty lists."""
    _distinct_names(table)
    spark, lines = table.rows.sparkSession, json_lines(table.rows, table.names) if table.names else None
    if lines is None or lines.isEmpty():
        only = "{" + ", ".join(f"{quoted(n)}: []" for n in table.names) + "}"
        return _put(spark, spark.createDataFrame([(only,)], "line string"), path)
    top = lines.agg(F.max(F.struct("file", "rid")).alias("m")).first()["m"]
    last = (F.col("file") == top["file"]) & (F.col("rid") == top["rid"])
    body = lines.withColumn("line", F.concat(F.lit(" "), F.col("line"), F.when(last, F.lit("")).otherwise(F.lit(","))))
    return _put(spark, _ordered(["["], body, ["]"]), path)


def write_json_lines(table: Table, path: str) -> None:
    """An object for each row. A table with columns and no rows is refused: its columns would be lost."""
    _distinct_names(table)
    lines = json_lines(table.rows, table.names)
    if lines.isEmpty():
        raise Refused("JSON Lines cannot hold columns without rows")
    _put(table.rows.sparkSession, lines.orderBy("file", "rid").select("line"), path)


def write_parquet(table: Table, path: str) -> None:
    """Every column as text, none null, in order."""
    _distinct_names(table)
    table.rows.orderBy("file", "rid").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(table.names)]).write.option("compression", "zstd").parquet(path)


def write_table(table: Table, path: str) -> None:
    kind = format_of(path)
    writer = {"json": write_json, "jsonl": write_json_lines, "parquet": write_parquet}.get(kind, write_delimited)
    if kind in ("dta", "sav", "zsav", "por", "sas7bdat", "xpt"):
        raise Refused("a table of text has no types for a statistics package")
    writer(table, path)


def convert(spark: SparkSession, source: str, target: str, encoding: str | None = None) -> None:
    write_table(read_table(spark, source, encoding), target)
