"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a document are hashed; a window's first occurrence is
the smallest (doc_id, line) that has its hash; every other occurrence covers three lines
to remove, and the covered lines of a document are merged before any goes. Only hashes
and positions are shuffled to find the windows; the first occurrence is pre-aggregated in
each task, and a window of many occurrences is looked up by broadcast or in salted copies,
so that a window of a third of all documents meets in no task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._shared import HEAVY_ROWS, checkpointed, looked_up

WIDTH = 3
_SECOND = 0x51ED270B  # makes the other 64 bits of a window's hash


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_lines(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, lines: the sorted numbers (from 0) of the lines to remove of every document that has any.

    Lines end at \\n; an empty line is a line. Texts with fewer lines than `width` have no window.
    A null text has no lines, a null id takes no part. text_key is the text's xxhash64, which tells rows of one
    doc_id apart and orders them; rows of one doc_id and one text are one document, whose lines stay or go in both.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), _lines(F.col(text_col)).alias("lines")).where(F.size("lines") >= width)
    hashes = F.transform(F.sequence(F.lit(1), F.size("lines") - (width - 1)), lambda i: F.struct(*_hashes(F.slice(F.col("lines"), i, width))))
    kept = checkpointed(rows.select("doc_id", "text_key", hashes.alias("windows")))
    windows = kept.select("doc_id", "text_key", F.posexplode("windows").alias("line", "window"))
    place = F.struct("doc_id", "text_key", "line")
    first = checkpointed(windows.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    heavy = checkpointed(first.where(F.col("n") > HEAVY_ROWS).select("window"))
    later = looked_up(windows, first.select("first", "window"), "window", heavy, F.lit(64)).where(place != F.col("first"))
    starts = later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("starts"))
    return starts.select("doc_id", "text_key", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))))).alias("lines"))


def _hashes(window: Column) -> list[Column]:
    # an array's hash depends on where its lines part
    return [F.xxhash64(window).alias("a"), F.xxhash64(F.lit(_SECOND), window).alias("b")]


def dedup_lines(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every column, and text without the lines that repeated_lines names; n_lines and n_removed beside it.

    A null text stays null with no lines; a text that loses all its lines becomes empty; a row with a null id keeps
    its lines. Repeated rows lose the same lines, rows of one doc_id with other texts are documents of their own.
    Columns of docs named n_lines or n_removed are replaced. An empty table gives an empty result.
    """
    plain = docs.drop("n_lines", "n_removed", "__covered", "__id", "__text", "__lines")
    covered = repeated_lines(docs, width, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), F.col("lines").alias("__covered"))
    joined = plain.join(covered, (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__text")), "left")
    joined = joined.withColumn("__lines", _lines(F.col(text_col)))
    # the lines that stay, by their numbers: array_except hashes, so that this is linear in the lines
    numbers = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__covered"))
    kept = F.when(F.col("__covered").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(numbers, lambda i: F.get(F.col("__lines"), i)), "\n"))
    n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long")
    removed = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("__covered")), F.lit(0)).cast("long")
    return joined.select(*[F.col(f"`{c}`") if c != text_col else kept.alias(c) for c in plain.columns], n.alias("n_lines"), removed.alias("n_removed"))


def line_digests(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the kept text's UTF-8; a null text counts as empty) of every row."""
    return dedup_lines(docs, width, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same rows in DuckDB, on the windows' texts.
ORACLE_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i - 1 AS line, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS win
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
o AS (SELECT doc_id, line, row_number() OVER (PARTITION BY win ORDER BY doc_id, line) AS k FROM w),
c AS (SELECT doc_id, list(DISTINCT line + d) AS gone FROM o, (VALUES (0), (1), (2)) AS t(d) WHERE k > 1 GROUP BY doc_id)
SELECT l.doc_id AS doc_id, coalesce(len(l.lines), 0) AS n_lines, coalesce(len(c.gone), 0) AS n_removed,
  sha256(coalesce(CASE WHEN c.gone IS NULL THEN l.text
    ELSE array_to_string(list_transform(list_filter(range(1, len(l.lines) + 1), lambda i: NOT list_contains(c.gone, i - 1)), lambda i: l.lines[i]), chr(10)) END, '')) AS kept_sha256
FROM l LEFT JOIN c ON l.doc_id = c.doc_id
"""
