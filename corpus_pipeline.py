"""A training-data pipeline over `documents`: quality, lines, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir); all but the last return rows with the columns of documents, further ones included whatever their names. SQL can't
express the classifier, the suffix sort and the tokenizer, so there is no ORACLE_SQL; tests hold the stages against brute force.

A null text counts as empty. Empty and blank texts pass the stages unchanged, if the classifier keeps them. Rows with one doc_id and one text are one
document, of which the third stage keeps one row. Null doc_ids come after all others. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm import jaccard_join, line_dedup, packing, quality, suffix_dedup
from codesieve.llm.common import Saved, documents, release

ORACLE_SQL = None


def rated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives the second grade or better with probability 0.5 or more; a document without text is judged like others."""
    return quality.select(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, n_chars (if among them) as the text now has it."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line that stands earlier in the corpus goes; a document that has lost all its lines goes too."""
    return counted(line_dedup.rewrite(docs, window=1, emptied=False), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five-word shingles, similarity 0.8."""
    return jaccard_join.representatives(docs, width=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that documents with smaller ids have go; a document that has lost all its bytes goes too.

    A character of which bytes are missing goes whole.
    """
    return counted(suffix_dedup.rewrite(docs), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, each a sequence whose length is a power of two."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), slice_bytes=1 << 20, remembered=200_000)  # executors hold much by the last stage


STAGES = [("quality", rated), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each stage's rows are written to the shared folder and read again."""
    saved, docs = Saved(spark), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = saved.save(kept, name)
        release(kept)  # what the stage before left, and the stage's own tables
    return STAGES[-1][1](spark, docs, sf_dir)
