"""Pattern sets: distinct n-grams, pairs, substrings, and samples of them that are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.keys import ngrams, printable

#: Upper ends of the bins of combined bucket spans, closed, and their labels. Fixed values of the reports.
SPAN_BINS = [(1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (None, ">50")]


def prefixes(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """Distinct lower-case prefixes of n characters of strings that have so many."""
    return df.where(F.length(column) >= n).select(F.lower(F.left(F.col(column), F.lit(n))).alias("ngram")).distinct()


def suffixes(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    return df.where(F.length(column) >= n).select(F.lower(F.right(F.col(column), F.lit(n))).alias("ngram")).distinct()


def pairs(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """Distinct (prefix, suffix) of one string."""
    return df.where(F.length(column) >= n).select(F.lower(F.left(F.col(column), F.lit(n))).alias("prefix"), F.lower(F.right(F.col(column), F.lit(n))).alias("suffix")).distinct()


def substrings(df: DataFrame, column: str, n: int, plain: bool = False) -> DataFrame:
    """Distinct lower-case substrings of n characters at every position; plain: of printable ASCII only."""
    out = df.select(F.explode(ngrams(F.lower(F.col(column)), n)).alias("ngram")).distinct()
    return out.where(printable(F.col("ngram"))) if plain else out


def safe(pattern: Column) -> Column:
    """Whether a pattern has none of the characters that SQL text or LIKE treats specially."""
    return ~pattern.rlike(r"['\\%_]")


def shuffled(seed: int, *columns: str) -> Column:
    """An order by hash, the same for the same values and seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))).cast("binary"))


def take(df: DataFrame, n: int, *columns: str, seed: int = 42) -> DataFrame:
    """n rows by hash of the columns."""
    return df.orderBy(shuffled(seed, *columns), *columns).limit(n)


def random_pairs(left: DataFrame, right: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n distinct pairs of two independent lists (ngram), without making all pairs.

    Each list is numbered in hash order; the i-th pair takes the i-th of one and, shifted by one more with each full turn, of the other.
    """
    def numbered(df: DataFrame, name: str, s: int) -> DataFrame:
        top = take(df.select(F.col("ngram").alias(name)).distinct(), n, name, seed=s)  # no more than n of each can be used
        return top.withColumn("i", F.row_number().over(Window.orderBy(shuffled(s, name), name)) - 1)

    a, b = numbered(left, "prefix", seed), numbered(right, "suffix", seed + 1)
    na, nb = a.count(), b.count()
    if not na or not nb:
        return a.select("prefix").limit(0).join(b.select("suffix").limit(0), F.lit(True))
    draws = left.sparkSession.range(min(n, na * nb)).select((F.col("id") % na).cast("int").alias("ia"), ((F.col("id") + F.floor(F.col("id") / (na * nb // _gcd(na, nb)))) % nb).cast("int").alias("ib"))
    return draws.join(a, F.col("ia") == a["i"]).join(b, F.col("ib") == b["i"]).select("prefix", "suffix")


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def pair_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many pairs two lists make: the product of their counts."""
    return left.agg(F.count("*").alias("n_prefixes")).join(right.agg(F.count("*").alias("n_suffixes")), F.lit(True)).withColumn("n_pairs", F.col("n_prefixes") * F.col("n_suffixes"))


def span_bin(span: Column) -> Column:
    out = None
    for top, label in SPAN_BINS[:-1]:
        out = F.when(span <= top, label) if out is None else out.when(span <= top, label)
    return out.otherwise(SPAN_BINS[-1][1])


def allocation(df: DataFrame, label: str, total: int, least: int, order: list[str]) -> DataFrame:
    """How many rows to take from each non-empty bin: `least` from each, then the rest in proportion, no more than there are.

    Bins get their least in order while rows are left. label, size, allocated.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))  # a row for each label
    place = F.array_position(F.array(*map(F.lit, order)), F.col(label))
    before = F.coalesce(F.sum(F.least("size", F.lit(least))).over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.withColumn("first", F.greatest(F.least(F.col("size"), F.lit(least), F.lit(total) - before), F.lit(0)))
    everything = Window.partitionBy()
    rest = F.lit(total) - F.sum("first").over(everything)
    share = F.floor(rest * F.col("size") / F.sum("size").over(everything)).cast("long")
    return first.withColumn("allocated", F.least(F.col("size"), F.col("first") + F.greatest(share, F.lit(0)))).select(label, "size", "allocated")


def stratified(df: DataFrame, label: str, total: int, least: int, order: list[str], *columns: str, seed: int = 42) -> DataFrame:
    """Rows of df by the allocation, within a bin by hash of the columns."""
    plan = allocation(df, label, total, least, order)
    ranked = df.join(F.broadcast(plan.select(label, "allocated")), label).withColumn("cs_rank", F.row_number().over(Window.partitionBy(label).orderBy(shuffled(seed, *columns), *columns)))  # one row for each label
    return ranked.where(F.col("cs_rank") <= F.col("allocated")).drop("cs_rank", "allocated")
