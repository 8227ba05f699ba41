"""Summaries of measurements: percentiles, geometric means, bins with stated edges, pivots, ratios of medians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.keys import geometric_mean


def quartiles(x: Column, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> Column:
    """Exact percentiles by linear interpolation."""
    return F.percentile(x, F.array(*map(F.lit, at)))


def ranked_percentiles(df: DataFrame, value: str, at: tuple[float, ...], *by: str, bins: int = 65_536) -> DataFrame:
    """by and q: the percentiles of `quartiles`, for groups whose distinct values no buffer holds.

    Rows are counted by value first; running counts are taken over equal steps between a group's least and greatest value, and then
    over the values in a step, so a task sorts the steps of a group, or the distinct values of one step. Nulls don't count; NaN isn't a number here.
    """
    x, keys = F.col(value).cast("double"), list(by) or ["cs_all"]
    rows = df if by else df.withColumn("cs_all", F.lit(0))
    counted = rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, x.alias("x")).agg(F.count("*").alias("n"))
    ends = counted.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("all"))
    step = F.when(F.col("high") > F.col("low"), F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * (bins - 1))).otherwise(F.lit(0)).cast("int")
    placed = counted.join(ends, keys).withColumn("step", step)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = placed.groupBy(*keys, "step").agg(F.sum("n").alias("n")).select(*keys, "step", earlier.alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "step").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.join(before, [*keys, "step"]).withColumn("upto", upto)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("x")))

    places = [F.lit(p) * (F.col("all") - 1) for p in at]
    pairs = ranked.groupBy(*keys, "all").agg(*[value_at(f(place)).alias(f"{name}{i}") for i, place in enumerate(places) for name, f in (("a", F.floor), ("b", F.ceil))])
    q = F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (place - F.floor(place)) for i, place in enumerate(places)])
    return pairs.select(*by, q.alias("q"))


def row_numbers(df: DataFrame, major: str, minor: str, *then: str, name: str = "cs_row") -> DataFrame:
    """df with a dense number from 0 of each row, in order of two columns of whole numbers and further columns of any kind, nulls last.

    A row's number is the rows of earlier ranges of 65,536 majors, those of earlier (major, 4,096 minors) in its own range, and its
    place there; so only one row for each range is numbered by a single task.
    """
    after, zero = Window.unboundedPreceding, F.lit(0)
    own = df.withColumns({"cs_range": F.shiftright(F.col(major).cast("long"), 16), "cs_part": F.shiftright(F.col(minor).cast("long"), 12)})
    sizes = own.groupBy("cs_range", F.col(major).alias("cs_major"), "cs_part").agg(F.count("*").alias("n"))
    ranges = sizes.groupBy(F.col("cs_range").alias("cs_of")).agg(F.sum("n").alias("all"))
    ranges = ranges.select("cs_of", F.coalesce(F.sum("all").over(Window.orderBy(F.asc_nulls_last("cs_of")).rowsBetween(after, -1)), zero).alias("base"))  # one row for each range
    within = F.coalesce(F.sum("n").over(Window.partitionBy("cs_range").orderBy(F.asc_nulls_last("cs_major"), F.asc_nulls_last("cs_part")).rowsBetween(after, -1)), zero)
    before = sizes.withColumn("within", within).join(ranges, F.col("cs_range").eqNullSafe(F.col("cs_of"))).select("cs_major", F.col("cs_part").alias("cs_minor"), (F.col("base") + F.col("within")).alias("cs_before"))
    place = F.row_number().over(Window.partitionBy(major, "cs_part").orderBy(*map(F.asc_nulls_last, (minor, *then)))) - 1
    placed = own.withColumn("cs_place", place).join(before, F.col(major).eqNullSafe(F.col("cs_major")) & F.col("cs_part").eqNullSafe(F.col("cs_minor")))
    return placed.select(*[own[c] for c in df.columns], (F.col("cs_before") + F.col("cs_place")).alias(name))


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, least, greatest and geometric mean of each group."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("least"), F.max(x).alias("greatest"), geometric_mean(x).alias("geomean"))


def edges_linear(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def edges_log(low: float, high: float, n: int) -> list[float]:
    return [10 ** x for x in edges_linear(math.log10(low), math.log10(high), n)]


def bin_of(x: Column, edges: list[float], right: bool, last_closed: bool = False) -> Column:
    """Number of the bin that has x, null outside: bins are (a, b] if right, else [a, b), the last one [a, b] with last_closed."""
    out = F.when(F.lit(False), F.lit(0))
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (x > a) & (x <= b) if right else (x >= a) & ((x <= b) if last_closed and i == len(edges) - 2 else (x < b))
        out = out.when(inside, F.lit(i))
    return out


def binned_mean(df: DataFrame, x: str, y: str, edges: list[float], right: bool, least: int = 1, geometric: bool = False) -> DataFrame:
    """bin, centre (of its edges), n and mean of y, for bins of `least` rows or more."""
    centres = [math.sqrt(a * b) if geometric else (a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    counted = df.withColumn("bin", bin_of(F.col(x), edges, right)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(y).alias("mean")).where(F.col("n") >= least)
    return counted.withColumn("centre", F.get(F.array(*map(F.lit, centres)), F.col("bin")))


def histogram(df: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """bin and n, empty bins too; the last bin has its upper edge."""
    counted = df.withColumn("bin", bin_of(F.col(x), edges, False, True)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def labelled_bins(x: Column, edges: list[float], labels: list[str], right: bool) -> Column:
    return F.get(F.array(*map(F.lit, labels)), bin_of(x, edges, right))


def median_ratio(df: DataFrame, kind: str, one: str, two: str, value: str, *by: str) -> DataFrame:
    """Median of the rows of either kind and their ratio, for groups that have both."""
    both = df.groupBy(*by).agg(F.median(F.when(F.col(kind) == one, F.col(value))).alias("one"), F.median(F.when(F.col(kind) == two, F.col(value))).alias("two"))
    return both.where("one is not null and two is not null").withColumn("ratio", F.when(F.col("two") > 0, F.col("one") / F.col("two")).otherwise(F.lit(0.0)))


def aligned(order: DataFrame, df: DataFrame, on: str, place: str) -> DataFrame:
    """df's rows in the order of a list, absent ones as nulls."""
    return order.join(df, on, "left").orderBy(place)
