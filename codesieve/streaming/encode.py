"""Codes of a stream: with fixed boundaries and features, encoding is a projection without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codesieve.operators.bitmask import Features
from codesieve.operators.quantile import Codes, assign


def encoded(stream: DataFrame, codes: list[Codes], features: Features | None = None) -> DataFrame:
    """The stream with a column for each encoding; up to 20 bits, as more need a sort of all rows."""
    for c in codes:
        if c.bits > 20:
            raise ValueError("codes of a stream have 20 bits at most")
        stream = assign(stream, c)
    return stream.withColumn(features.name, features.column(F.col(codes[0].column))) if features else stream


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
