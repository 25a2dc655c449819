"""A corpus pipeline: quality, line dedup, near-duplicate documents, repeated passages, packing.

Each stage works on all rows of the stage before it. All but the last return the columns of
`documents`; where a stage changes a text, n_chars is counted again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._shared import checkpointed, measured
from quillon.llm.jaccard_join import jaccard_join
from quillon.llm.line_dedup import dedup_lines
from quillon.llm.packing import pack_documents
from quillon.llm.quality import train_quality, with_quality
from quillon.llm.substring_dedup import dedup_substrings


_OWN = ("doc_id", "text")


def _apart(docs: DataFrame) -> DataFrame:
    """docs with every column but its id and text under a name that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in _OWN else f"__own{i}") for i, c in enumerate(docs.columns)])


def _restored(result: DataFrame, docs: DataFrame, recount: bool = False) -> DataFrame:
    """docs' columns of a result made from _apart(docs); recount: n_chars (where there is one) as the text now has it."""
    own = lambda i, c: F.col(c if c in _OWN else f"__own{i}")
    return result.select(*[(F.char_length("text").cast("long") if recount and c == "n_chars" else own(i, c)).alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, trained on the labelled ones among them, accepts.

    A null text is judged as an empty one; rows that repeat an id are judged by their own texts.
    """
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _restored(with_quality(_apart(docs), model).where("predicted = 1"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of repeated three-line windows. Null texts stay null."""
    return _restored(dedup_lines(_apart(docs)), docs, recount=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more connect: that of the smallest doc_id.

    Rows without an id belong to no group and stay; rows that repeat an id are judged by their own texts, and
    those that repeat a text with it are one document, which stays or goes in all of them.
    """
    others = jaccard_join(docs).where("NOT stays").select(F.col("doc_id").alias("__other"), F.col("text_key").alias("__text")).distinct()
    others = measured(checkpointed(others), F.lit(32))
    rows = _apart(docs)
    same = (rows["doc_id"].cast("long") == others["__other"]) & (F.xxhash64(F.coalesce(rows["text"], F.lit(""))) == others["__text"])
    return _restored(rows.join(others, same, "left_anti"), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 13-word sequences that a smaller doc_id has too. Null texts stay null."""
    return _restored(dedup_substrings(_apart(docs)), docs, recount=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of 4096 tokens.

    A null or empty text is one piece of the end id alone; a null id stays null; an empty table gives an empty result.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The first stage is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table documents, each one's result kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
