"""Hashed text features for linear models, and the bounded sample of rated documents that a model is fitted on.

A row's features are shares that add up to one in each kind: of its words, hashed; and of its runs of four
bytes, hashed, in which letters and digits count as their kind, so that shape, punctuation and bytes beyond ASCII are
left. Besides, how much it repeats its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import SLICE_BYTES, flat, hash_words, ranges, row_sums, sliced, text_bytes, view, words

#: Bytes of a run, and steps of repetition.
GRAM, STEPS = 4, 10


def size(bits: int) -> int:
    """Features with 2 ** bits values of each kind of hash: runs, words, repetition."""
    return 2 * (1 << bits) + STEPS + 1


def byte_runs(data: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash below 2 ** bits of each run of GRAM bytes that lies in one row, and where each row's runs start."""
    kind = np.arange(256, dtype=np.uint32)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = ord("a"), ord("A"), ord("0")
    shaped = kind[data]
    n = max(0, len(shaped) - GRAM + 1)
    hashed = np.zeros(n, np.uint32)
    for k in range(GRAM):
        hashed = hashed * np.uint32(0x01000193) + shaped[k : k + n]
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x85EBCA6B)
    hashed >>= np.uint32(32 - bits)
    lengths = np.maximum(np.diff(starts) - GRAM + 1, 0)
    return hashed[ranges(starts[:-1], lengths)].astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def kinds(column: pa.ChunkedArray | pa.Array, bits: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The feature number of each run and of each word, with where each row's start, and that of each row's repetition: tenths of its words that are distinct, all without words."""
    column = flat(column)
    runs = byte_runs(*text_bytes(column), bits)
    dictionary, codes, starts = words(column)
    hashed = (hash_words(dictionary) >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits)
    counts, n = np.diff(starts), max(1, len(dictionary))
    rows = np.repeat(np.arange(len(counts)), counts)
    distinct = np.bincount(np.unique(rows * n + codes) // n, minlength=len(counts))
    repeated = np.where(counts, STEPS * distinct // np.maximum(counts, 1), STEPS).astype(np.int64)
    return runs, (hashed[codes], starts), repeated + 2 * (1 << bits)


def scores(weights: np.ndarray, column: pa.ChunkedArray | pa.Array, bits: int) -> np.ndarray:
    """The linear score of each row."""
    runs, own_words, repeated = kinds(column, bits)
    return weights[repeated] + sum(row_sums(weights[x], at) / np.maximum(np.diff(at), 1) for x, at in (runs, own_words))


def table(column: pa.ChunkedArray | pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all that aren't 0, each once, by row."""
    runs, own_words, repeated = kinds(column, bits)
    keys, values = [np.arange(len(repeated)) * size(bits) + repeated], [np.ones(len(repeated))]
    for x, at in (runs, own_words):
        counts = np.diff(at)
        rows = np.repeat(np.arange(len(counts)), counts)
        key, n = np.unique(rows * size(bits) + x, return_counts=True)
        keys.append(key)
        values.append(n / counts[key // size(bits)])
    keys, values = np.concatenate(keys), np.concatenate(values)
    by = np.argsort(keys)
    return keys[by] // size(bits), keys[by] % size(bits), values[by]


def rated_sample(docs: DataFrame, ratings: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id, text and rating of rows of at most `most` rated documents: those whose doc_id hashes lowest.

    The choice is made on ids alone. A doc_id with several ratings counts with its lowest; null ids and ratings don't count. Of
    rows that share a doc_id, the one with the least text is taken.
    """
    ids = ratings.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(column).cast("int")).alias("rating"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return view(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("rating").alias("rating"))


def one_task(sample: DataFrame) -> DataFrame:
    """A bounded sample in one partition and a set order; what it is made from stays in many."""
    return sample.select("text", "rating", F.xxhash64("doc_id").alias("o")).repartition(1).sortWithinPartitions("o", "text")


def parts(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from sliced(batch, most=most)
