"""Command line: build code columns, scan, report, ingest. python -m codesieve.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions import keys
from codesieve.operators import bitmask, metrics, patterns, quantile, stats
from codesieve.plans import reports
from codesieve.plans.predicates import Index, Match
from codesieve.sources import io

#: (prefix, suffix) pairs of the fixed comparison. Fixed values.
FIXED_PAIRS = (("the", "a"), ("the", "e"), ("a", "s"), ("in", "on"), ("re", "ed"), ("2", "1"))
#: Lengths of sampled substrings. Fixed values.
LENGTHS = (3, 4, 5, 6, 8, 10)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codesieve")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *extra: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for x in extra:
            p.add_argument(x)
        return p

    def timed(p: argparse.ArgumentParser, warmup: int, reps: int) -> None:
        p.add_argument("--warmup", type=int, default=warmup)
        p.add_argument("--reps", type=int, default=reps)

    def widths(p: argparse.ArgumentParser) -> None:
        p.add_argument("--prefix-bits", type=int, default=8)
        p.add_argument("--suffix-bits", type=int, default=8)

    p = command("titles", "one column of a tab-separated file as Parquet", "input", "output")
    p.add_argument("--column", default="primaryTitle")
    p = command("build", "add a prefix or suffix code", "input", "output")
    p.add_argument("--bits", type=int, default=8)
    p.add_argument("--suffix", action="store_true")
    p = command("build-infix", "add prefix and suffix codes, or both in one column", "input", "output")
    p.add_argument("--prefix-bits", type=int, default=8)
    p.add_argument("--suffix-bits", type=int, default=8)
    p.add_argument("--combined", action="store_true")
    p = command("build-substr", "add a presence bitmask", "input", "output")
    p.add_argument("--bits", type=int, default=16)
    p.add_argument("--sample", type=int, default=200_000)
    p.add_argument("--ngram", type=int, default=2)
    p.add_argument("--max-freq", type=float, default=0.01)
    p = command("scan", "count and least match of patterns, with masks and without, and row groups skipped", "input", "features")
    p.add_argument("--patterns", nargs="+", required=True)
    p.add_argument("--output")
    p.add_argument("--group-rows", type=int, default=metrics.SEGMENT_ROWS)
    p = command("report", "every prefix or suffix n-gram: matches, code range, prune rate, and times if repeated", "input", "output")
    p.add_argument("--bits", type=int, default=8)
    p.add_argument("--suffix", action="store_true")
    p.add_argument("--n", type=int, default=3)
    timed(p, 2, 0)
    p = command("pairs", "time (prefix, suffix) pairs: of random lists, of the rows, or of the rows stratified by bucket span", "input", "output")
    widths(p)
    p.add_argument("--choice", choices=("random", "rows", "stratified"), default="stratified")
    p.add_argument("--n", type=int, default=3)
    p.add_argument("--samples", type=int, default=100)
    p.add_argument("--least", type=int, default=5)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--explain", action="store_true")
    timed(p, 1, 3)
    for name, text in (("compare", "plain, two code columns and the packed one"), ("six-way", "prefix, suffix and infix by those three ways")):
        p = command(name, text, "input", "output")
        widths(p)
        p.add_argument("--samples", type=int, default=0, help="pairs of the rows; the fixed ones if 0")
        p.add_argument("--n", type=int, default=3)
        p.add_argument("--seed", type=int, default=42)
        timed(p, 2, 5)
    p = command("infix-sweep", "timing files ..._p8_s8.csv of the fixed pairs for several pairs of widths", "input", "output")
    p.add_argument("--bits", nargs="+", default=[f"{a},{b}" for a, b in reports.BIT_PAIRS])
    timed(p, 2, 10)
    p = command("bit-sweep", "timings of patterns for codes of several widths", "input", "output")
    p.add_argument("--patterns", nargs="+", required=True)
    p.add_argument("--bits", nargs="+", type=int, default=list(range(1, 29)))
    p.add_argument("--suffix", action="store_true")
    timed(p, 1, 3)
    p = command("substrings", "time sampled substrings with masks and without", "input", "features", "output")
    p.add_argument("--samples", type=int, default=100, help="of each length")
    p.add_argument("--seed", type=int, default=42)
    timed(p, 1, 3)
    p = command("profile", "timed profiles of prefixes, or of PREFIX..SUFFIX pairs, with their zones", "input", "output")
    p.add_argument("--patterns", nargs="+", required=True)
    widths(p)
    timed(p, 2, 5)
    p = command("segments", "simulate which segments codes of several widths let prefixes skip, in the order of a row number", "input", "output", "order")
    p.add_argument("--patterns", nargs="+", required=True)
    p.add_argument("--bits", nargs="+", type=int, default=list(range(1, 17)))
    p.add_argument("--rows", type=int, default=metrics.SEGMENT_ROWS)
    p = command("group-sweep", "row groups that masks let a scan skip, for several sizes", "input", "features", "output")
    p.add_argument("--patterns", nargs="+", required=True)
    p.add_argument("--rows", nargs="+", type=int, default=list(reports.GROUP_ROWS))
    p = command("repartition", "rewrite in row groups of other sizes", "input", "output")
    p.add_argument("--rows", type=int, default=122_880)
    p.add_argument("--code")
    p.add_argument("--compression", default="snappy")
    p = command("summarise", "median ratio of timing files ..._p8_s8.csv by query kind, added to a growing table", "input", "output")
    p.add_argument("--full", default="full")
    p.add_argument("--coded", default="fp_exact")
    p = command("plot", "a picture of two columns of a report", "input", "output", "x", "y")
    p.add_argument("--kind", choices=("scatter", "line", "bar"), default="scatter")
    p = command("clean", "delete built tables by glob pattern", "input")
    for p in sub.choices.values():
        p.add_argument("--text", default="title", help="the string column")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    text = args.text
    if args.command == "titles":
        io.read_titles(spark, args.input, args.column, text).write.mode("overwrite").parquet(args.output)
        return
    if args.command == "summarise":
        runs = io.read_runs(spark, args.input, "bits int, source string, prefix string, query string, run int, time_s double")
        io.write_csv(stats.median_ratio(runs, "query", args.full, args.coded, "time_s", "combo", "prefix_bits", "suffix_bits", "source", "prefix"), args.output, add=True)
        return
    if args.command == "clean":
        print(*io.clean(spark, args.input), sep="\n")
        return
    if args.command == "plot":
        reports.plot(io.read_csv(spark, args.input, infer=True), args.x, args.y, args.output, args.kind)
        return
    df = io.read_table(spark, args.input)
    if text not in df.columns:
        raise SystemExit(f"no column {text} in {args.input}")
    if args.command == "build":
        codes = quantile.boundaries(df, text, args.bits, args.suffix, "linear")
        coded = quantile.assign(df, codes)
        coded.write.mode("overwrite").parquet(args.output)
        io.save_boundaries(spark, codes, f"{args.output}.boundaries")
        edges = quantile.boundary_table(spark, codes)
        io.write_csv(edges.select("bucket_id", keys.unsigned(F.col("key")).alias("boundary_u64"), keys.readable(F.col("key"), args.suffix).alias("text")), f"{args.output}.boundaries_csv")
        io.write_csv(quantile.bucket_stats(coded, codes.name).orderBy("bucket_id"), f"{args.output}.buckets")
        io.write_csv(patterns.take(coded.select(text, codes.name), 200, text), f"{args.output}.sample")
        quantile.bucket_summary(coded, codes.name).show()
    elif args.command == "build-infix":
        p, s = (quantile.boundaries(df, text, b, x, "linear") for b, x in ((args.prefix_bits, False), (args.suffix_bits, True)))
        out = quantile.pack(df, p, s) if args.combined else quantile.assign(quantile.assign(df, p), s)
        out.write.mode("overwrite").parquet(args.output)
        for c in (p, s):
            io.save_boundaries(spark, c, f"{args.output}.{c.name}")
    elif args.command == "build-substr":
        numbered = patterns.take(df.select(text).withColumn("cs_id", F.monotonically_increasing_id()), args.sample, text)
        features = bitmask.select_features(numbered, text, "cs_id", args.bits, args.ngram, args.max_freq)
        io.save_features(spark, features, f"{args.output}.features")
        df.withColumn(features.name, features.column(F.col(text))).write.mode("overwrite").parquet(args.output)
    elif args.command in ("scan", "substrings", "group-sweep"):
        features = io.load_features(spark, args.features)
        if args.command == "scan":
            found = reports.scan_report(df, text, args.patterns, features, args.group_rows)
            if args.output:
                io.write_csv(found, args.output)
            for r in found.collect():
                print(*r, "same" if r.same else "differs")
        elif args.command == "substrings":
            lists = [patterns.take(patterns.substrings(df, text, n, plain=True), args.samples, "ngram", seed=args.seed) for n in LENGTHS]
            io.write_csv(reports.substrings(df, text, [r.ngram for x in lists for r in x.collect()], features, args.warmup, args.reps), args.output)
        else:
            masks = {x: metrics.all_of(Index(features=features).conditions(Match(text, inside=x))) for x in args.patterns}
            io.write_csv(reports.group_sweep(df, masks, args.rows), args.output)
    elif args.command == "report":
        codes = quantile.boundaries(df, text, args.bits, args.suffix)
        coded = quantile.assign(df, codes)
        found = metrics.prefix_report(coded, text, codes, args.n)
        io.write_csv(reports.timed_grams(coded.cache(), text, found, codes, args.warmup, args.reps) if args.reps else found, args.output)
    elif args.command == "bit-sweep":
        io.write_csv(reports.bit_sweep(df, text, args.patterns, args.bits, args.suffix, args.warmup, args.reps), args.output)
    elif args.command == "infix-sweep":
        pairs = [tuple(map(int, x.split(","))) for x in args.bits]
        for (a, b), runs in reports.infix_sweep(df, text, FIXED_PAIRS, pairs, args.warmup, args.reps).items():
            io.write_csv(runs, f"{args.output}_p{a}_s{b}.csv")
    elif args.command == "segments":
        io.write_csv(reports.segment_sweep(df, text, args.order, args.patterns, args.bits, args.rows), args.output)
    elif args.command in ("pairs", "compare", "six-way", "profile"):
        p, s = quantile.boundaries(df, text, args.prefix_bits), quantile.boundaries(df, text, args.suffix_bits, True)
        coded = quantile.assign(quantile.assign(df, p), s)
        if args.command == "profile":
            matches = {x: Match(text, prefix=x.partition("..")[0], suffix=x.partition("..")[2]) for x in args.patterns}
            zones = reports.INFIX_ZONES if any(m.suffix for m in matches.values()) else reports.PREFIX_ZONES
            io.write_csv(reports.timed_profiles(coded.cache(), matches, Index(p, s), zones, args.warmup, args.reps), f"{args.output.removesuffix('.csv')}_profiles.csv")
        elif args.command == "pairs":
            chosen = chosen_pairs(df, text, p, s, args)
            io.write_csv(reports.paired(coded.cache(), text, chosen, p, s, args.warmup, args.reps, print if args.explain else None), args.output)
        else:
            chosen = [tuple(r) for r in patterns.take(patterns.pairs(df, text, args.n), args.samples, "prefix", "suffix", seed=args.seed).collect()] if args.samples else FIXED_PAIRS
            both = coded.withColumn("q16_infix", F.shiftleft(p.name, s.bits).bitwiseOR(F.col(s.name))).cache()
            run = reports.three_way if args.command == "compare" else reports.six_way
            io.write_csv(run(both, text, chosen, p, s, "q16_infix", args.warmup, args.reps), args.output)
    elif args.command == "repartition":
        io.write_clustered(df, args.output, args.code, group_rows=args.rows, compression=args.compression)
        io.row_groups(spark, args.output).agg(F.count("*").alias("row_groups"), F.max("rows").alias("most_rows")).show()


def chosen_pairs(df: DataFrame, text: str, p: quantile.Codes, s: quantile.Codes, args: argparse.Namespace) -> list[tuple[str, str]]:
    """The (prefix, suffix) pairs that `pairs` times."""
    if args.choice == "random":
        return [tuple(r) for r in patterns.random_pairs(patterns.prefixes(df, text, args.n), patterns.suffixes(df, text, args.n), args.samples, args.seed).collect()]
    every = patterns.pairs(df, text, args.n)
    if args.choice == "stratified":
        wide = F.lit(1)
        for codes, name in ((p, "prefix"), (s, "suffix")):
            low, high = (quantile.code_of(codes, quantile.pattern_key(F.col(name), codes.suffix, fill)) for fill in "0F")
            wide = wide * (high - low + 1)
        order = [label for _, label in patterns.SPAN_BINS]
        every = patterns.stratified(every.withColumn("bin", patterns.span_bin(wide)), "bin", args.samples, args.least, order, "prefix", "suffix", seed=args.seed).select("prefix", "suffix")
    return [tuple(r) for r in patterns.take(every, args.samples, "prefix", "suffix", seed=args.seed).collect()]


if __name__ == "__main__":
    main()
