"""What the codes save: selectivity, spans, pruning, false positives, and skipping of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.keys import ratio
from codesieve.operators.patterns import span_bin
from codesieve.operators.quantile import Codes, code_of, pattern_key
from codesieve.plans.predicates import Index, Match

#: Rows of a segment when none are given.
SEGMENT_ROWS = 122_880


def count_all(df: DataFrame, conditions: dict[str, Column], name: str = "pattern") -> DataFrame:
    """(name, match_count) of many conditions, in one scan."""
    keys = list(conditions)
    counted = df.agg(*[F.count_if(conditions[k]).alias(f"c{i}") for i, k in enumerate(keys)])
    rows = F.array(*[F.struct(F.lit(k).alias(name), F.col(f"c{i}").alias("match_count")) for i, k in enumerate(keys)])
    return counted.select(F.inline(rows))


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def profiles(df: DataFrame, matches: dict[str, Match], index: Index) -> DataFrame:
    """Of each match: rows, rows that its integer conditions leave, exact matches, and the measures from them. One scan for all."""
    names = list(matches)
    aggs = [F.count("*").alias("total_rows")]
    for i, k in enumerate(names):
        kept = all_of(index.conditions(matches[k]))
        aggs += [F.count_if(kept).alias(f"r{i}"), F.count_if(kept & matches[k].exact()).alias(f"m{i}")]
    rows = F.array(*[F.struct(F.lit(k).alias("query"), F.col(f"r{i}").alias("bucket_size"), F.col(f"m{i}").alias("actual_matches")) for i, k in enumerate(names)])
    return measures(df.agg(*aggs).select("total_rows", F.inline(rows)))


def measures(counts: DataFrame) -> DataFrame:
    """From total_rows, bucket_size and actual_matches: the percentages of a profile, rounded to six digits."""
    total, bucket, found = F.col("total_rows"), F.col("bucket_size"), F.col("actual_matches")
    return counts.select(
        "query", "total_rows", "bucket_size", "actual_matches", (bucket - found).alias("false_positives"),
        F.round(100 * ratio(found, total), 6).alias("selectivity_pct"), F.round(100 * (1 - ratio(bucket, total)), 6).alias("prune_rate_pct"),
        F.round(100 * ratio(found, bucket), 6).alias("bucket_efficiency_pct"), F.round(100 * ratio(bucket - found, bucket), 6).alias("fp_ratio_pct"),
    )


def prefix_report(coded: DataFrame, column: str, codes: Codes, n: int = 3) -> DataFrame:
    """Every distinct n-gram at the coded end: matches, code range, rows in it, prune rate.

    Matches come from grouping rows by their n-gram, ranges from the boundaries, and rows in a range from the
    running count of rows by code: no pattern is searched for in the table.
    """
    gram = F.right if codes.suffix else F.left
    long_enough = coded.where(F.length(column) >= n).select(F.lower(gram(F.col(column), F.lit(n))).alias("ngram"))
    matches = long_enough.groupBy("ngram").agg(F.count("*").alias("match_count"))
    low, high = (code_of(codes, pattern_key(F.col("ngram"), codes.suffix, fill)) for fill in "0F")
    ranged = matches.select("ngram", "match_count", low.alias("bucket_lo"), high.alias("bucket_hi"))
    sizes = {r[0]: r[1] for r in coded.groupBy(codes.name).count().collect()}  # one row for each code in use
    running, total = [0], 0
    for i in range(1 << codes.bits):
        total += sizes.get(i, 0)
        running.append(total)
    held = F.array(*map(F.lit, running))
    rows = (F.get(held, F.col("bucket_hi") + 1) - F.get(held, F.col("bucket_lo"))).cast("long")
    return ranged.select("ngram", "match_count", "bucket_lo", "bucket_hi", (F.col("bucket_hi") - F.col("bucket_lo") + 1).alias("bucket_span"), rows.alias("rows_in_buckets"), F.round(F.col("match_count") / F.lit(max(total, 1)), 9).alias("selectivity"), F.round(1 - rows / F.lit(max(total, 1)), 9).alias("prune_rate"))


def segment_pruning(coded: DataFrame, order: str, name: str, ranges: dict[str, tuple[int, int]], rows: int = SEGMENT_ROWS) -> DataFrame:
    """For each query's code range: segments of `rows` rows, and how many the least and greatest code of a segment exclude.

    A row's segment is its number in `order`, a dense column from 0, divided by `rows`.
    """
    zones = coded.groupBy(F.floor(F.col(order) / rows).alias("segment")).agg(F.min(name).alias("low"), F.max(name).alias("high"))
    keys = list(ranges)
    counts = zones.agg(F.count("*").alias("segments"), *[F.count_if((F.col("high") < lo) | (F.col("low") > hi)).alias(f"s{i}") for i, (lo, hi) in enumerate(ranges.values())])
    out = F.array(*[F.struct(F.lit(k).alias("query"), F.col(f"s{i}").alias("skipped")) for i, k in enumerate(keys)])
    return counts.select("segments", F.inline(out)).withColumn("skipped_pct", F.round(100 * F.col("skipped") / F.col("segments"), 6))


def with_span_bin(report: DataFrame) -> DataFrame:
    return report.withColumn("span_bin", span_bin(F.col("bucket_span")))
