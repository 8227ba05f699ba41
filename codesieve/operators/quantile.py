"""Quantile codes: boundaries over string keys, and the bucket of each row."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.keys import KEY_BYTES, folded, key, key_text

#: Widest code; bits up to which boundaries are literals of the plan, and up to which an array is broadcast.
WIDEST, LITERAL_BITS, BROADCAST_BITS = 28, 10, 20


@dataclass(frozen=True)
class Codes:
    """An encoding of one column: `boundaries` are 2 ** bits keys in order, the code of a row is its last boundary not above its key."""

    column: str
    bits: int
    suffix: bool
    boundaries: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"q{self.bits}_{'suffix' if self.suffix else 'prefix'}"

    def code(self, key_hex: str) -> int:
        return max(0, bisect_right(self.boundaries, key_hex) - 1)

    def range(self, pattern: str) -> tuple[int, int]:
        """First and last code that strings beginning (or ending) with the pattern can have: all codes for the empty one."""
        return self.code(key_text(pattern, self.suffix, "0")), self.code(key_text(pattern, self.suffix, "F"))


@dataclass(frozen=True)
class WideCodes:
    """An encoding too wide for the driver: `edges` has each key k that is a boundary, and how many boundaries (n) it is."""

    column: str
    bits: int
    suffix: bool
    edges: DataFrame

    name = Codes.name

    def range(self, pattern: str) -> tuple[int, int]:
        """First and last code that strings beginning (or ending) with the pattern can have, by one pass over the boundaries."""
        ends = [F.coalesce(F.sum(F.when(F.col("k") <= key_text(pattern, self.suffix, fill), F.col("n"))), F.lit(0)) for fill in "0F"]
        return tuple(max(0, int(x) - 1) for x in self.edges.agg(*ends).first())


def running(counted: DataFrame) -> DataFrame:
    """The rows of (k, n, ...), with `upto`: the sum of n over all keys up to and with k. Keys are distinct.

    Sums are taken over ranges of two bytes, of four, and then of keys, so that a task sorts 65,536 ranges at most, or the distinct
    keys that begin with the same four bytes.
    """
    ranged = counted.withColumns({"r": F.substring("k", 1, 4), "q": F.substring("k", 1, 8)})
    fine = ranged.groupBy("r", "q").agg(F.sum("n").alias("all"))
    coarse = fine.groupBy("r").agg(F.sum("all").alias("all")).select("r", F.coalesce(F.sum("all").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # 65,536 rows at most
    within = F.coalesce(F.sum("all").over(Window.partitionBy("r").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = fine.withColumn("within", within).join(F.broadcast(coarse), "r").select("q", (F.col("base") + F.col("within")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("q").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("inside", inside).join(before, "q").withColumn("upto", F.col("before") + F.col("inside")).select(*counted.columns, "upto")


def ranked(counted: DataFrame) -> DataFrame:
    """k and the ranks `low` to `high` - 1 that each key has among all rows, from keys k with their numbers of rows n."""
    return running(counted).select("k", (F.col("upto") - F.col("n")).alias("low"), F.col("upto").alias("high"))


def boundaries(df: DataFrame, column: str, bits: int, suffix: bool = False, method: str = "lower") -> Codes:
    """Boundaries at equal shares of the sorted keys of all rows.

    lower: the key at rank floor(i * (n - 1) / 2 ** bits). linear: numpy's interpolated percentiles of the keys as
    numbers, made monotone. An empty table has all boundaries at the least key. Up to BROADCAST_BITS bits; see wide_boundaries.
    """
    if not 1 <= bits <= BROADCAST_BITS:
        raise ValueError(f"bits must be 1 to {BROADCAST_BITS} here, wider codes are made by wide_boundaries")
    counted = df.select(key(F.col(column), suffix).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    size = 1 << bits
    n = df.count()
    if not n:
        return Codes(column, bits, suffix, ("0" * 16,) * size)
    # Interpolation needs the next rank too, and its floating-point rank may be one off.
    spare = 0 if method == "lower" else 2
    steps = max(n - 1, 1)
    # The first i whose rank is not below `low`: its rank is one of the key's, or none is.
    first = f"(greatest(low - {spare}, 0) * {size}L + {steps - 1}L) div {steps}L"
    held = ranked(counted).where(f"{first} < {size} and ({first}) * {n - 1}L div {size}L < high + {spare}").orderBy("low").collect()  # 5 * 2 ** bits rows at most
    keys, ends = np.array([r.k for r in held]), np.array([r.high for r in held])

    def at(ranks: np.ndarray) -> np.ndarray:
        return keys[np.searchsorted(ends, ranks, side="right")]

    if method == "lower":
        return Codes(column, bits, suffix, tuple(at(np.arange(size) * (n - 1) // size).tolist()))
    place = np.arange(size) * 100 / size / 100 * (n - 1)
    floor = np.floor(place).astype(np.int64)
    left, right = (np.array([int(k, 16) for k in at(x)], np.uint64) for x in (floor, np.minimum(floor + 1, n - 1)))
    share, gap = place - floor, right - left
    values = np.where(share >= 0.5, right - gap * (1 - share), left + gap * share)
    points = np.maximum.accumulate(values.clip(0, float(2**64 - 2048)).astype(np.uint64))
    return Codes(column, bits, suffix, tuple(f"{int(x):016X}" for x in points))


def wide_boundaries(df: DataFrame, column: str, bits: int, suffix: bool = False) -> WideCodes:
    """Boundaries by the rule `lower`, as a table that never comes to the driver; any width up to WIDEST."""
    if not 1 <= bits <= WIDEST:
        raise ValueError(f"bits must be 1 to {WIDEST}")
    counted = df.select(key(F.col(column), suffix).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    size, steps = 1 << bits, max(df.count() - 1, 1)

    def below(rank: str) -> Column:
        """How many boundaries have a smaller rank."""
        return F.expr(f"least((cast({rank} as decimal(38, 0)) * {size} + {steps - 1}) div {steps}, {size}L)")

    edges = ranked(counted).select("k", (below("high") - below("low")).cast("long").alias("n")).where("n > 0")
    return WideCodes(column, bits, suffix, edges)


def code_of(codes: Codes, own: Column) -> Column:
    """The code of a key: one step of binary search for each bit, over literal boundaries."""
    held = F.array(*map(F.lit, codes.boundaries))
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(codes.bits))])
    pair = F.struct(own.alias("k"), held.alias("b"))
    return F.get(F.transform(F.array(pair), lambda s: F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(s["b"], at + step) <= s["k"], at + step).otherwise(at))), 0)


def code_column(codes: Codes) -> Column:
    return code_of(codes, key(F.col(codes.column), codes.suffix))


def pattern_key(pattern: Column, suffix: bool, fill: str) -> Column:
    """keys.key_text of a column of patterns: filled with F, the greatest key that a string beginning with the pattern can have."""
    return F.rpad(F.hex(F.substring(F.encode(folded(pattern, suffix), "UTF-8"), 1, KEY_BYTES)), 2 * KEY_BYTES, fill)


def wide_boundaries(df: DataFrame, column: str, bits: int, suffix: bool = False) -> WideCodes:
    """Boundaries by the rule `lower`, as a table that never comes to the driver; any width up to WIDEST."""
    if not 1 <= bits <= WIDEST:
        raise ValueError(f"bits must be 1 to {WIDEST}")
    counted = df.select(key(F.col(column), suffix).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    size, steps = 1 << bits, max(df.count() - 1, 1)

    def below(rank: str) -> Column:
        """How many boundaries have a smaller rank."""
        return F.expr(f"least((cast({rank} as decimal(38, 0)) * {size} + {steps - 1}) div {steps}, {size}L)")

    edges = ranked(counted).select("k", (below("high") - below("low")).cast("long").alias("n")).where("n > 0")
    return WideCodes(column, bits, suffix, edges)


def code_column(codes: Codes) -> Column:
    """The code as an expression: one step of binary search for each bit, over literal boundaries."""
    held = F.array(*map(F.lit, codes.boundaries))
    own = key(F.col(codes.column), codes.suffix)
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(codes.bits))])
    pair = F.struct(own.alias("k"), held.alias("b"))
    return F.get(F.transform(F.array(pair), lambda s: F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(s["b"], at + step) <= s["k"], at + step).otherwise(at))), 0)


def assign(df: DataFrame, codes: Codes | WideCodes, name: str | None = None) -> DataFrame:
    """df with the code column, an int. Boundaries of up to 10 bits are literals, of up to 20 an array on each executor; beyond, rows and boundaries are sorted together."""
    name = name or codes.name
    if isinstance(codes, WideCodes):
        return assign_sorted(df, codes.edges, codes, name)
    if codes.bits <= LITERAL_BITS:
        return df.withColumn(name, code_column(codes))
    held = df.sparkSession.sparkContext.broadcast(np.array([int(k, 16) for k in codes.boundaries], np.uint64))  # at most 8 MB

    @F.pandas_udf("int")
    def lookup(keys: pd.Series) -> pd.Series:
        values = np.array([int(k, 16) for k in keys], np.uint64)
        return pd.Series(np.maximum(np.searchsorted(held.value, values, side="right") - 1, 0).astype(np.int32))

    return df.withColumn(name, lookup(key(F.col(codes.column), codes.suffix)))


def assign_sorted(df: DataFrame, edges: DataFrame, codes: Codes | WideCodes, name: str) -> DataFrame:
    """The as-of lookup by sorting: how many boundaries lie up to each distinct key. Rows are joined by key. edges: a row k for each boundary, or k and how many are equal (n)."""
    if "n" not in edges.columns:
        edges = edges.groupBy("k").agg(F.count("*").alias("n"))
    rows = df.withColumn("cs_key", key(F.col(codes.column), codes.suffix))
    asked = rows.select(F.col("cs_key").alias("k")).distinct().select("k", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks"))
    both = edges.select("k", "n", F.lit(False).alias("asks")).union(asked).groupBy("k").agg(F.sum("n").alias("n"), F.max("asks").alias("asks"))
    found = running(both).where("asks").select("k", F.greatest(F.col("upto") - 1, F.lit(0)).cast("int").alias(name))
    return rows.join(found, rows["cs_key"] == found["k"]).drop("cs_key", "k")


def narrow(df: DataFrame, *codes: Codes | WideCodes) -> DataFrame:
    """Code columns in the smallest type that holds them: two bytes up to 15 bits, else four."""
    return df.withColumns({c.name: F.col(c.name).cast("short" if c.bits < 16 else "int") for c in codes})


def pack(df: DataFrame, prefix: Codes, suffix: Codes, name: str = "q16_infix") -> DataFrame:
    """df with both codes in one number of at most 16 bits, the prefix's above the suffix's."""
    if prefix.bits + suffix.bits > 16:
        raise ValueError("packed codes have 16 bits at most")
    both = assign(assign(df, prefix, "cs_p"), suffix, "cs_s")
    return both.withColumn(name, F.shiftleft("cs_p", suffix.bits).bitwiseOR(F.col("cs_s"))).drop("cs_p", "cs_s")


def bucket_stats(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.col(name).alias("bucket_id")).agg(F.count("*").alias("row_count"))


def bucket_summary(df: DataFrame, name: str) -> DataFrame:
    return bucket_stats(df, name).agg(F.count("*").alias("non_empty"), F.max("row_count").alias("largest"), F.min("row_count").alias("smallest"), F.avg("row_count").alias("mean_rows"))


def running_max(edges: DataFrame) -> DataFrame:
    """Boundaries made monotone in order of bucket_id; there are 2 ** bits of them, so one window holds them."""
    return edges.withColumn("key", F.max("key").over(Window.orderBy("bucket_id").rowsBetween(Window.unboundedPreceding, 0)))


def boundary_table(spark, codes: Codes) -> DataFrame:
    return spark.createDataFrame(list(enumerate(codes.boundaries)), "bucket_id int, key string")
