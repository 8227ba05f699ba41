"""Timing and plans of queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame


def time_query(make: Callable[[], DataFrame], warmup: int = 1, reps: int = 3) -> list[float]:
    """Milliseconds of each repetition after some that don't count; the whole result is computed and dropped."""
    out = []
    for i in range(warmup + reps):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        if i >= warmup:
            out.append(1000 * (time.perf_counter() - start))
    return out


def median_ms(make: Callable[[], DataFrame], warmup: int = 1, reps: int = 3) -> float:
    return median(time_query(make, warmup, reps))


def plan(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def pushed(df: DataFrame) -> list[str]:
    """What the plan pushes into scans."""
    return [line.split("PushedFilters:", 1)[1].strip() for line in plan(df).splitlines() if "PushedFilters:" in line]
