"""Timed comparisons of plain and coded queries, profiles with zones, scan reports and sweeps, as tables.

Every way's result is counted before it is timed, so a row also shows that the ways agree. Times are medians in
milliseconds after runs that don't count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators import bitmask, metrics, quantile
from codesieve.operators.bitmask import Features
from codesieve.operators.quantile import Codes
from codesieve.plans.predicates import Index, Match
from codesieve.plans.timing import time_query
from codesieve.sources import io

#: Speed-up zones of profiles: name, least, most. Fixed values of the reports.
PREFIX_ZONES = (("high", 13.0, math.inf), ("middle", 5.0, 8.0), ("low", 2.0, 4.0))
INFIX_ZONES = (("high", 14.0, math.inf), ("middle", 12.0, 14.0), ("low", 0.0, 12.0))
#: Rows of a row group in sweeps. Fixed values of the reports.
GROUP_ROWS = (10_000, 50_000, 122_880, 500_000)
#: (prefix bits, suffix bits) of sweeps over pairs of codes. Fixed values of the reports.
BIT_PAIRS = ((4, 4), (8, 8), (4, 8), (8, 4), (8, 12), (12, 8), (12, 12), (16, 16))


def counting(df: DataFrame, conditions: Iterable[Column]) -> Callable[[], DataFrame]:
    keep = metrics.all_of(list(conditions))
    return lambda: df.where(keep).agg(F.count("*").alias("n"))


class Ways:
    """Counts and median times of one match by several ways; `plain` is the scan without codes."""

    def __init__(self, ways: dict[str, Callable[[], DataFrame]], warmup: int, reps: int):
        self.counts = {k: f().first()[0] for k, f in ways.items()}
        self.times = {k: median(time_query(f, warmup, reps)) for k, f in ways.items()}

    def speedup(self, way: str, plain: str = "plain") -> float:
        return self.times[plain] / max(self.times[way], 1e-6)

    @property
    def same(self) -> bool:
        return len(set(self.counts.values())) == 1


def spans(codes: Iterable[tuple[Codes | None, str]]) -> list[int]:
    return [c.range(p)[1] - c.range(p)[0] + 1 for c, p in codes if c]


def table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def three_way(df: DataFrame, column: str, pairs: Iterable[tuple[str, str]], p: Codes, s: Codes, packed: str, warmup: int = 2, reps: int = 5) -> DataFrame:
    """Each (prefix, suffix) by plain scan, by two code columns and by the packed one; df has all three columns."""
    total, rows = df.count(), []
    two, one = Index(prefix=p, suffix=s), Index(prefix=p, suffix=s, packed=packed)
    for a, b in pairs:
        m = Match(column, prefix=a, suffix=b)
        ways = Ways({"plain": counting(df, [m.exact()]), "two_col": counting(df, [*two.conditions(m), m.exact()]), "combined16": counting(df, [*one.conditions(m), m.exact()])}, warmup, reps)
        wide = spans([(p, a), (s, b)])
        rows.append({"prefix": a, "suffix": b, "match_count": ways.counts["plain"], "selectivity": ways.counts["plain"] / max(total, 1), "prefix_bucket_span": wide[0], "suffix_bucket_span": wide[1], "combined_bucket_span": wide[0] * wide[1], "time_full_ms": ways.times["plain"], "time_two_col_ms": ways.times["two_col"], "time_combined16_ms": ways.times["combined16"], "speedup_two_col": ways.speedup("two_col"), "speedup_combined16": ways.speedup("combined16"), "same": ways.same})
    return table(df.sparkSession, rows, "prefix string, suffix string, match_count long, selectivity double, prefix_bucket_span int, suffix_bucket_span int, combined_bucket_span int, time_full_ms double, time_two_col_ms double, time_combined16_ms double, speedup_two_col double, speedup_combined16 double, same boolean")


def six_way(df: DataFrame, column: str, pairs: Iterable[tuple[str, str]], p: Codes, s: Codes, packed: str, warmup: int = 2, reps: int = 5) -> DataFrame:
    """Each (prefix, suffix) as prefix, suffix and infix, each by plain scan, two code columns and the packed one."""
    total, rows, kinds = df.count(), [], ("prefix", "suffix", "infix")
    two, one = Index(prefix=p, suffix=s), Index(prefix=p, suffix=s, packed=packed)
    for a, b in pairs:
        wide = spans([(p, a), (s, b)])
        row = {"prefix": a, "suffix": b, "prefix_bucket_span": wide[0], "suffix_bucket_span": wide[1], "combined_bucket_span": wide[0] * wide[1], "same": True}
        for kind, m in zip(kinds, (Match(column, prefix=a), Match(column, suffix=b), Match(column, prefix=a, suffix=b)), strict=True):
            ways = Ways({"plain": counting(df, [m.exact()]), "2col": counting(df, [*two.conditions(m), m.exact()]), "1col": counting(df, [*one.conditions(m), m.exact()])}, warmup, reps)
            row |= {f"match_count_{kind}": ways.counts["plain"], f"sel_{kind}": ways.counts["plain"] / max(total, 1), f"time_full_{kind}": ways.times["plain"], "same": row["same"] and ways.same}
            row |= {f"{what}_{kind}_{way}": value for way in ("2col", "1col") for what, value in (("time", ways.times[way]), ("speedup", ways.speedup(way)))}
        rows.append(row)
    columns = ["prefix string", "suffix string", *[f"match_count_{k} long" for k in kinds], *[f"sel_{k} double" for k in kinds], "prefix_bucket_span int", "suffix_bucket_span int", "combined_bucket_span int", *[f"time_full_{k} double" for k in kinds], *[f"{what}_{k}_{w} double" for what in ("time", "speedup") for k in kinds for w in ("2col", "1col")], "same boolean"]
    return table(df.sparkSession, rows, ", ".join(columns))


def paired(df: DataFrame, column: str, pairs: Iterable[tuple[str, str]], p: Codes, s: Codes, warmup: int = 1, reps: int = 5, show: Callable[[str], None] | None = None) -> DataFrame:
    """Each (prefix, suffix) by plain scan and by two code columns, with the rows that these leave. show: gets each coded plan."""
    from codesieve.plans import timing

    total, rows, index = df.count(), [], Index(prefix=p, suffix=s)
    for a, b in pairs:
        m = Match(column, prefix=a, suffix=b)
        left = counting(df, index.conditions(m))().first()[0]
        fast = counting(df, [*index.conditions(m), m.exact()])
        ways = Ways({"plain": counting(df, [m.exact()]), "coded": fast}, warmup, reps)
        wide = spans([(p, a), (s, b)])
        rows.append({"prefix": a, "suffix": b, "match_count": ways.counts["plain"], "selectivity": ways.counts["plain"] / max(total, 1), "prefix_bucket_span": wide[0], "suffix_bucket_span": wide[1], "combined_bucket_span": wide[0] * wide[1], "rows_in_buckets": left, "prune_rate": 1 - left / max(total, 1), "time_full_ms": ways.times["plain"], "time_fp_ms": ways.times["coded"], "speedup": ways.speedup("coded"), "same": ways.same})
        if show:
            show(timing.plan(fast()))
    return table(df.sparkSession, rows, "prefix string, suffix string, match_count long, selectivity double, prefix_bucket_span int, suffix_bucket_span int, combined_bucket_span int, rows_in_buckets long, prune_rate double, time_full_ms double, time_fp_ms double, speedup double, same boolean")


def timed_grams(df: DataFrame, column: str, report: DataFrame, codes: Codes, warmup: int = 2, reps: int = 5) -> DataFrame:
    """The rows of a prefix report (see metrics.prefix_report) with the times of the plain and the coded query of each n-gram."""
    rows, names = [], report.columns
    for r in report.orderBy("ngram").toLocalIterator():
        m = Match(column, suffix=r.ngram) if codes.suffix else Match(column, prefix=r.ngram)
        index = Index(suffix=codes) if codes.suffix else Index(prefix=codes)
        ways = Ways({"plain": counting(df, [m.exact()]), "coded": counting(df, [*index.conditions(m), m.exact()])}, warmup, reps)
        rows.append({**r.asDict(), "time_full_ms": ways.times["plain"], "time_fp_ms": ways.times["coded"], "speedup": ways.speedup("coded")})
    types = dict(report.dtypes)
    return table(df.sparkSession, rows, ", ".join([f"{n} {types[n]}" for n in names] + ["time_full_ms double", "time_fp_ms double", "speedup double"]))


def substrings(df: DataFrame, column: str, patterns: Iterable[str], features: Features, warmup: int = 1, reps: int = 3) -> DataFrame:
    """Each pattern by plain scan and with its mask first; df has the mask column."""
    total, rows = df.count(), []
    for x in patterns:
        m, mask, index = Match(column, inside=x), features.mask(x), Index(features=features)
        passed = counting(df, index.conditions(m))().first()[0]
        ways = Ways({"plain": counting(df, [m.exact()]), "masked": counting(df, [*index.conditions(m), m.exact()])}, warmup, reps)
        found = ways.counts["plain"]
        rows.append({"pattern": x, "pattern_length": len(x), "mask": mask, "mask_bits": mask.bit_count(), "match_count": found, "fp_count": passed, "selectivity": found / max(total, 1), "fp_rate": (passed - found) / max(total, 1), "time_full_ms": ways.times["plain"], "time_fp_ms": ways.times["masked"], "speedup": ways.speedup("masked"), "same": ways.same})
    return table(df.sparkSession, rows, "pattern string, pattern_length int, mask int, mask_bits int, match_count long, fp_count long, selectivity double, fp_rate double, time_full_ms double, time_fp_ms double, speedup double, same boolean")


def timed_profiles(df: DataFrame, matches: dict[str, Match], index: Index, zones: tuple = PREFIX_ZONES, warmup: int = 2, reps: int = 5) -> DataFrame:
    """The profiles of metrics.profiles with the median times of the plain and the coded query, their ratio, and its zone (null for none)."""
    rows = []
    for r in metrics.profiles(df, matches, index).collect():
        m = matches[r["query"]]
        ways = Ways({"plain": counting(df, [m.exact()]), "coded": counting(df, [*index.conditions(m), m.exact()])}, warmup, reps)
        gain = ways.speedup("coded")
        rows.append({**r.asDict(), "full_time_ms": ways.times["plain"], "fp_time_ms": ways.times["coded"], "speedup": gain, "zone": next((n for n, low, high in zones if low <= gain <= high), None)})
    return table(df.sparkSession, rows, "query string, full_time_ms double, fp_time_ms double, speedup double, total_rows long, bucket_size long, selectivity_pct double, actual_matches long, prune_rate_pct double, bucket_efficiency_pct double, false_positives long, fp_ratio_pct double, zone string")


def group_report(df: DataFrame, keep: Column, rows: int) -> DataFrame:
    """groups, skipped and skipped_pct: row groups of `rows` rows in which no row meets the condition, so their strings need not be read."""
    found = io.groups(df, rows, keep).agg(F.count("*").alias("total"), F.count_if(F.col("kept") == 0).alias("skipped"))
    return found.select(F.lit(rows).alias("group_rows"), F.col("total").alias("groups_total"), F.col("skipped").alias("groups_skipped"), (F.col("total") - F.col("skipped")).alias("groups_loaded"), F.when(F.col("total") > 0, F.round(100 * F.col("skipped") / F.col("total"), 6)).otherwise(F.lit(0.0)).alias("skipped_pct"))


def pruned_groups(spark: SparkSession, path: str, column: str, low: int, high: int) -> DataFrame:
    """groups_total and groups_skipped: row groups of a table on disk whose statistics of a code column exclude a range, as a scan skips them."""
    found = io.row_groups(spark, path, column)
    return found.agg(F.count("*").alias("groups_total"), F.count_if((F.col("high").cast("long") < low) | (F.col("low").cast("long") > high)).alias("groups_skipped"))


def scan_report(df: DataFrame, column: str, patterns: Iterable[str], features: Features, rows: int = metrics.SEGMENT_ROWS, warmup: int = 0, reps: int = 1) -> DataFrame:
    """Each pattern's count and least match by masked and plain scan, groups skipped and loaded, and milliseconds of either."""
    out = []
    for x in patterns:
        fast, plain = bitmask.scan(df, column, x, features), bitmask.scan(df, column, x)
        keep = metrics.all_of(Index(features=features).conditions(Match(column, inside=x)))
        skipped, one, two = group_report(df, keep, rows).first(), fast.first(), plain.first()
        times = [median(time_query(lambda q=q: q, warmup, reps)) for q in (fast, plain)]
        out.append({"pattern": x, "mask": features.mask(x), "match_count": one.match_count, "least": one.least, "groups_total": skipped.groups_total, "groups_skipped": skipped.groups_skipped, "groups_loaded": skipped.groups_loaded, "masked_ms": times[0], "plain_ms": times[1], "same": one == two})
    return table(df.sparkSession, out, "pattern string, mask int, match_count long, least string, groups_total long, groups_skipped long, groups_loaded long, masked_ms double, plain_ms double, same boolean")


def group_sweep(df: DataFrame, conditions: dict[str, Column], sizes: Iterable[int] = GROUP_ROWS) -> DataFrame:
    """The group report of each condition for row groups of several sizes; nothing is rewritten."""
    out: DataFrame | None = None
    for name, keep in conditions.items():
        for n in sizes:
            own = group_report(df, keep, n).select(F.lit(name).alias("pattern"), "*")
            out = own if out is None else out.unionByName(own)
    return out


def ordered_group_sweep(df: DataFrame, conditions: dict[str, Column], number: str, sizes: Iterable[int] = GROUP_ROWS) -> DataFrame:
    """The same for groups of rows by a dense row number, wherever the rows lie; all conditions are counted in one pass for each size."""
    out: DataFrame | None = None
    for n in sizes:
        found = df.groupBy(F.floor(F.col(number) / n)).agg(*[F.count_if(keep).alias(f"k{i}") for i, keep in enumerate(conditions.values())])
        found = found.agg(F.count("*").alias("total"), *[F.count_if(F.col(f"k{i}") == 0).alias(f"s{i}") for i in range(len(conditions))])
        each = [F.struct(F.lit(name).alias("pattern"), F.lit(n).alias("group_rows"), F.col("total").alias("groups_total"), F.col(f"s{i}").alias("groups_skipped"), (F.col("total") - F.col(f"s{i}")).alias("groups_loaded")) for i, name in enumerate(conditions)]
        own = found.select(F.inline(F.array(*each)))
        out = own if out is None else out.unionByName(own)
    return out


def runs(spark: SparkSession, name: str, ways: dict[str, Callable[[], DataFrame]], bits: int, source: str, warmup: int, reps: int) -> list[tuple]:
    """(bits, source, prefix, query, run, time_s) of each repetition of each way."""
    return [(bits, source, name, way, i, ms / 1000) for way, f in ways.items() for i, ms in enumerate(time_query(f, warmup, reps))]


RUNS_SCHEMA = "bits int, source string, prefix string, query string, run int, time_s double"


def bit_sweep(df: DataFrame, column: str, patterns: Iterable[str], widths: Iterable[int], suffix: bool = False, warmup: int = 1, reps: int = 3) -> DataFrame:
    """Every repetition of each pattern's plain and coded query, for codes of several widths; up to 20 bits by literals or an array, beyond by sorting."""
    spark, out = df.sparkSession, []
    for bits in widths:
        codes = quantile.boundaries(df, column, bits, suffix) if bits <= quantile.BROADCAST_BITS else quantile.wide_boundaries(df, column, bits, suffix)
        coded = quantile.narrow(quantile.assign(df, codes), codes).persist()
        coded.count()
        for x in patterns:
            m = Match(column, suffix=x) if suffix else Match(column, prefix=x)
            index = Index(suffix=codes) if suffix else Index(prefix=codes)
            out += runs(spark, x, {"full": counting(df, [m.exact()]), "fp_exact": counting(coded, [*index.conditions(m), m.exact()])}, bits, "suffix" if suffix else "prefix", warmup, reps)
        coded.unpersist()
    return spark.createDataFrame(out, RUNS_SCHEMA)


def infix_sweep(df: DataFrame, column: str, pairs: Iterable[tuple[str, str]], widths: Iterable[tuple[int, int]] = BIT_PAIRS, warmup: int = 2, reps: int = 10) -> dict[tuple[int, int], DataFrame]:
    """For each pair of widths, every repetition of each (prefix, suffix) by plain scan and by two code columns."""
    spark, out, pairs = df.sparkSession, {}, list(pairs)
    for a_bits, b_bits in widths:
        p, s = quantile.boundaries(df, column, a_bits), quantile.boundaries(df, column, b_bits, True)
        coded = quantile.narrow(quantile.assign(quantile.assign(df, p), s), p, s).persist()
        coded.count()
        rows = []
        for a, b in pairs:
            m = Match(column, prefix=a, suffix=b)
            rows += runs(spark, f"{a}..{b}", {"full": counting(df, [m.exact()]), "fp_exact": counting(coded, [*Index(prefix=p, suffix=s).conditions(m), m.exact()])}, a_bits + b_bits, "view", warmup, reps)
        coded.unpersist()
        out[a_bits, b_bits] = spark.createDataFrame(rows, RUNS_SCHEMA)
    return out


def segment_sweep(df: DataFrame, column: str, order: str, patterns: Iterable[str], widths: Iterable[int] = range(1, 17), rows: int = metrics.SEGMENT_ROWS) -> DataFrame:
    """Segments that codes of several widths let each prefix skip, by simulation; order: a dense row number."""
    out: DataFrame | None = None
    for bits in widths:
        codes = quantile.boundaries(df, column, bits)
        own = metrics.segment_pruning(quantile.assign(df, codes), order, codes.name, {x: codes.range(x) for x in patterns}, rows).select(F.lit(bits).alias("bits"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def plot(df: DataFrame, x: str, y: str, path: str, kind: str = "scatter", most: int = 100_000) -> None:
    """A scatter, line or bar picture of a small report table as PNG; needs matplotlib."""
    try:
        from matplotlib import pyplot
    except ImportError as error:
        raise RuntimeError("plots need matplotlib") from error
    rows = df.select(x, y).orderBy(x).limit(most).collect()
    figure, axes = pyplot.subplots()
    getattr(axes, {"line": "plot"}.get(kind, kind))([r[0] for r in rows], [r[1] for r in rows])
    axes.set_xlabel(x)
    axes.set_ylabel(y)
    figure.savefig(path)
    pyplot.close(figure)
