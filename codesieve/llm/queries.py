"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm import bpe, context_tree, fingerprints, jaccard_join, line_dedup, packing, quality, suffix_dedup, telephony, toxicity
from codesieve.llm.common import documents, fold

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(documents(spark, sf_dir), fold(7, 2))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.counts(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), fold(3, 1)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.counts(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir), width=4, percent=85)


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.store(documents(spark, sf_dir), keep=False)


def queries() -> dict[str, Query]:
    return {"op1_packing": op1_packing, "op2_quality": op2_quality, "op3_context_tree": op3_context_tree, "op4_suffix_dedup": op4_suffix_dedup, "op5_toxicity": op5_toxicity, "op6_line_dedup": op6_line_dedup, "op7_fingerprints": op7_fingerprints, "op8_bpe": op8_bpe, "op9_jaccard_join": op9_jaccard_join, "op10_telephony": op10_telephony}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": line_dedup.ORACLE_SQL}
