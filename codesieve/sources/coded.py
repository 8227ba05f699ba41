"""Coded tables: written once with their code columns, clustered by code, and queried through them.

A filter on a code range reaches the Parquet scan, which skips the row groups whose statistics exclude it; the
exact predicate runs on the rows that are left.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators import metrics, quantile
from codesieve.plans.predicates import Index, Match, accelerate
from codesieve.sources import io


@dataclass(frozen=True)
class CodedTable:
    """A table on disk and the codes that it has."""

    path: str
    index: Index

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def rows(self, spark: SparkSession, match: Match, way: str = "range") -> DataFrame:
        """The rows that match."""
        return accelerate(self.read(spark), match, self.index, way)

    def candidates(self, spark: SparkSession, matches: list[Match], way: str = "range") -> DataFrame:
        """The rows that the integer conditions of some match leave: one filter, pushed into the scan."""
        any_of: Column | None = None
        for match in matches:
            own = self.index.conditions(match, way)
            if not own:
                return self.read(spark)
            any_of = metrics.all_of(own) if any_of is None else any_of | metrics.all_of(own)
        return self.read(spark) if any_of is None else self.read(spark).where(any_of)

    def count(self, spark: SparkSession, matches: dict[str, Match], way: str = "range") -> DataFrame:
        """(pattern, match_count) of all matches, from one scan of the candidates."""
        conditions = {k: metrics.all_of([*self.index.conditions(m, way), m.exact()]) for k, m in matches.items()}
        return metrics.count_all(self.candidates(spark, list(matches.values()), way), conditions)


def write(df: DataFrame, path: str, column: str, prefix_bits: int = 0, suffix_bits: int = 0, packed: bool = False, method: str = "lower", partitions: int | None = None, block_bytes: int | None = None) -> CodedTable:
    """Write df with prefix and suffix codes (as many bits as given, none for 0), clustered by the prefix's, or the packed column, or else the suffix's.

    A code that many rows share is spread over files by the hash of its text.
    """
    p, s = (quantile.boundaries(df, column, bits, suffix, method) if bits else None for bits, suffix in ((prefix_bits, False), (suffix_bits, True)))
    own = [c for c in (p, s) if c]
    if not own or packed and len(own) < 2:
        raise ValueError("a coded table has a code, a packed one has two")
    name = "q16_infix" if packed else None
    for c in [] if packed else own:
        df = quantile.assign(df, c)
    df = quantile.pack(df, p, s, name) if packed else quantile.narrow(df, *own)
    io.write_clustered(df, path, name or own[0].name, partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), block_bytes=block_bytes, spread=F.xxhash64(column))
    return CodedTable(path, Index(prefix=p, suffix=s, packed=name))


#: Coded tables of this process by application and recipe.
_made: dict[tuple, CodedTable] = {}


def made(spark: SparkSession, source: str, column: str, **recipe) -> CodedTable:
    """The coded table of a Parquet source in the session's work folder, written when a query first needs it; see `write` for the recipe."""
    key = (spark.sparkContext.applicationId, source, column, json.dumps(recipe, sort_keys=True))
    if key not in _made:
        path = f"{io.work_folder(spark)}/codesieve-coded-{hashlib.sha256(repr(key).encode()).hexdigest()[:24]}"
        _made[key] = write(spark.read.parquet(source), path, column, **recipe)
    return _made[key]


def drop_made(spark: SparkSession) -> None:
    """Delete the coded tables that `made` has written for this application."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        io.clean(spark, _made.pop(key).path)
