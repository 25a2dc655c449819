"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exact_search, line_dedup, substring_dedup
from quillon.llm.jaccard_join import jaccard_join
from quillon.llm.packing import pack_documents
from quillon.llm.piece_codec import piece_digests
from quillon.llm.quality import score_quality, train_quality
from quillon.llm.simhash import edited_fingerprints, with_near_counts
from quillon.llm.token_counts import token_counts
from quillon.llm.toxicity import score_toxicity, train_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near_counts(edited_fingerprints(_table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, _table(spark, sf_dir, "labels")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(_table(spark, sf_dir, "embeddings"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_jaccard_join, op3_fingerprints, op4_toxicity, op5_line_dedup, op6_best_fit_packing, op7_quality, op8_exact_top_k, op9_piece_codec, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.ORACLE_SQL, "op8_exact_top_k": exact_search.ORACLE_SQL, "op10_substring_dedup": substring_dedup.ORACLE_SQL}
