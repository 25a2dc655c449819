"""What the two classifiers share: a bounded training sample, and training in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._workers import lean

FOLDS = 5
#: Characters of text that a training sample has at most, beside its bound on rows.
TRAINING_CHARS = 200_000_000


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and y of at most `most` labelled documents outside fold 0: those of the smallest hash of the id.

    Ids with a null label are left out; an id labelled twice takes the larger label.
    The ids chosen are at most `most`, so that the join with documents broadcasts them.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold() != 0).groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "id").select("id", "text", "y")


def trained(rows: DataFrame, fit: Callable[[list[str], list[int]], bytes], most_chars: int = TRAINING_CHARS) -> bytes:
    """What `fit` makes of the rows, in one task on an executor; the rows are few by training_rows, and
    each that would take those kept before it, in the order of the id's hash, past `most_chars`
    characters is left out by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        y: list[int] = []
        size = 0
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                if size + len(text) <= most_chars:
                    size += len(text)
                    texts.append(text)
                    y.append(label)
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, y)], pa.binary())], names=["model"])

    # neither by id nor by class
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "text")
    model = ordered.select("text", "y").mapInArrow(lean(run), "model binary").first()  # none without rows
    return bytes(model["model"]) if model else fit([], [])
