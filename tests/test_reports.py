"""Coded tables, timed comparisons, profiles and sweeps: all ways agree, columns are as stated, row groups are skipped."""

import pytest
from pyspark.sql import functions as F

from codesieve.functions import keys
from codesieve.operators import bitmask, quantile
from codesieve.plans import reports, timing
from codesieve.plans.predicates import Index, Match
from codesieve.sources import coded, io

WORDS = ["the end", "the cat", "a dog", "dogs", "cathedral", "the dog", "Theme", "éa b", "", None, "x" * 30]


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(2000).select("id", F.element_at(F.array(*map(F.lit, WORDS)), (F.col("id") % len(WORDS) + 1).cast("int")).alias("text")).cache()


@pytest.fixture(scope="module")
def both(table):
    p, s = quantile.boundaries(table, "text", 4), quantile.boundaries(table, "text", 4, True)
    df = quantile.assign(quantile.assign(table, p), s).withColumn("q16_infix", F.shiftleft(p.name, s.bits).bitwiseOR(F.col(s.name))).cache()
    return df, p, s


def test_coded_table_counts_and_skips(spark, table, tmp_path):
    matches = {x: Match("text", prefix=x) for x in ("the", "a", "zzz", "é")} | {"the..d": Match("text", prefix="the", suffix="d")}
    want = {k: table.where(m.exact()).count() for k, m in matches.items()}
    for recipe in ({"prefix_bits": 4}, {"prefix_bits": 4, "suffix_bits": 4}, {"prefix_bits": 4, "suffix_bits": 4, "packed": True}):
        own = coded.write(table, str(tmp_path / f"t{len(recipe)}"), "text", partitions=6, **recipe)
        for way in ("range", "shift", "in"):
            assert {r.pattern: r.match_count for r in own.count(spark, matches, way).collect()} == want
        assert sorted(r.id for r in own.rows(spark, matches["the"]).collect()) == sorted(r.id for r in table.where(matches["the"].exact()).collect())
    own = coded.write(table, str(tmp_path / "c"), "text", prefix_bits=4, partitions=6)
    assert "GreaterThanOrEqual(q4_prefix" in str(timing.pushed(own.rows(spark, matches["the"])))
    # A code that many rows share lies in several files, and most files have few codes.
    spans = own.read(spark).groupBy(F.input_file_name().alias("f")).agg((F.max("q4_prefix") - F.min("q4_prefix")).alias("w"))
    assert spans.count() > 2 and spans.agg(F.min("w")).first()[0] <= 2
    with pytest.raises(ValueError):
        coded.write(table, str(tmp_path / "x"), "text")
    table.write.parquet(str(tmp_path / "source"))
    once = coded.made(spark, str(tmp_path / "source"), "text", prefix_bits=3)
    assert coded.made(spark, str(tmp_path / "source"), "text", prefix_bits=3) is once and io.exists(spark, once.path)
    coded.drop_made(spark)
    assert not io.exists(spark, once.path)


def test_wide_codes_equal_narrow_ones(spark, table):
    wide, narrow = quantile.wide_boundaries(table, "text", 8), quantile.boundaries(table, "text", 8)
    assert wide.name == narrow.name and all(wide.range(x) == narrow.range(x) for x in ("the", "a", "", "é", "zzz"))
    assert {(r.id, r.q8_prefix) for r in quantile.assign(table, wide).select("id", "q8_prefix").collect()} == {(r.id, r.q8_prefix) for r in quantile.assign(table, narrow).select("id", "q8_prefix").collect()}
    widest = quantile.wide_boundaries(table, "text", 28)
    assert widest.edges.agg(F.sum("n")).first()[0] == 1 << 28
    assert dict(quantile.narrow(quantile.assign(quantile.assign(table, narrow), widest), narrow, widest).dtypes)["q8_prefix"] == "smallint"
    with pytest.raises(ValueError):
        quantile.boundaries(table, "text", 21)


def test_running_counts_over_ranges(spark):
    df = spark.range(3000).select(F.upper(F.lpad(F.hex((F.col("id") * 7919) % 5000), 16, "0")).alias("k"), (F.col("id") % 5).alias("n")).dropDuplicates(["k"])
    rows = sorted((r.k, r.n) for r in df.collect())
    total, want = 0, {}
    for k, n in rows:
        total += n
        want[k] = total
    assert {r.k: r.upto for r in quantile.running(df).collect()} == want


def test_ngrams(spark):
    texts = ["", "a", "ab", "añ😀b", "x" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keys.ngrams(F.col("t"), 2).alias("g")).collect()
    assert {r.t: r.g for r in got} == {t: [t[i : i + 2] for i in range(len(t) - 1)] for t in texts}


def test_ways_agree(both):
    df, p, s = both
    pairs = [("the", "d"), ("a", "g"), ("zz", "z")]
    three = reports.three_way(df, "text", pairs, p, s, "q16_infix", 0, 1).collect()
    six = reports.six_way(df, "text", pairs, p, s, "q16_infix", 0, 1)
    two = reports.paired(df, "text", pairs, p, s, 0, 1).collect()
    for r, q, t in zip(three, six.collect(), two, strict=True):
        found = df.where(Match("text", prefix=r.prefix, suffix=r.suffix).exact()).count()
        assert r.same and q.same and t.same and r.match_count == q.match_count_infix == t.match_count == found
        assert r.combined_bucket_span == r.prefix_bucket_span * r.suffix_bucket_span and t.rows_in_buckets >= found
    assert {"time_full_prefix", "speedup_infix_1col", "time_suffix_2col", "sel_infix"} <= set(six.columns)


def test_profiles_scans_and_substrings(both):
    df, p, _ = both
    prof = {r["query"]: r for r in reports.timed_profiles(df, {x: Match("text", prefix=x) for x in ("the", "zz")}, Index(prefix=p), ((("any", 0.0, float("inf"))),), 0, 1).collect()}
    assert prof["the"].actual_matches == df.where("lower(text) like 'the%'").count() and prof["zz"].actual_matches == 0 and prof["the"].zone == "any"
    features = bitmask.Features(("th", "do", "ca", "xx"), 2)
    masked = df.withColumn(features.name, features.column(F.col("text")))
    subs = {r.pattern: r for r in reports.substrings(masked, "text", ["the", "dog", "qq"], features, 0, 1).collect()}
    assert all(r.same and r.fp_count >= r.match_count for r in subs.values()) and subs["the"].mask_bits == 1


def test_groups_are_skipped(spark, table, tmp_path):
    features = bitmask.Features(("th", "do", "ca", "xx"), 2)
    table.orderBy("text").coalesce(1).withColumn(features.name, features.column(F.col("text"))).write.parquet(str(tmp_path / "m"))
    df = spark.read.parquet(str(tmp_path / "m"))
    out = {r.pattern: r for r in reports.scan_report(df, "text", ["the", "xxx", "none"], features, 100).collect()}
    assert all(r.same and r.groups_skipped + r.groups_loaded == r.groups_total == 20 for r in out.values())
    assert out["xxx"].groups_skipped > 10 and out["none"].groups_skipped == 0
    masks = {x: F.col(features.name).bitwiseAND(F.lit(features.mask(x))) == features.mask(x) for x in ("the", "xxx")}
    sweep = reports.group_sweep(df, masks, (100, 1000)).collect()
    assert {(r.pattern, r.group_rows, r.groups_total) for r in sweep} == {(x, n, 2000 // n) for x in masks for n in (100, 1000)}


def test_row_groups_have_stated_rows_and_statistics(spark, table, tmp_path):
    codes = quantile.boundaries(table, "text", 4)
    io.write_clustered(quantile.narrow(quantile.assign(table, codes), codes).coalesce(1), str(tmp_path / "g"), codes.name, 1, group_rows=100)
    found = io.row_groups(spark, str(tmp_path / "g"), codes.name)
    assert found.agg(F.sum("rows")).first()[0] == 2000 and found.agg(F.max("rows")).first()[0] <= 100
    low, high = codes.range("the")
    got = reports.pruned_groups(spark, str(tmp_path / "g"), codes.name, low, high).first()
    assert got.groups_total >= 20 and 0 < got.groups_skipped < got.groups_total
    kept = spark.read.parquet(str(tmp_path / "g")).where(F.col(codes.name).between(low, high)).count()
    assert kept <= 100 * (got.groups_total - got.groups_skipped)


def test_sweeps(spark, table, tmp_path):
    runs = reports.bit_sweep(table, "text", ["the", "d"], [1, 4, 21], False, 0, 2).collect()
    assert len(runs) == 3 * 2 * 2 * 2 and {r.bits for r in runs} == {1, 4, 21}
    found = reports.infix_sweep(table, "text", [("the", "d")], [(2, 3), (4, 4)], 0, 1)
    for (a, b), df in found.items():
        io.write_csv(df, str(tmp_path / f"runs_p{a}_s{b}.csv"))
    read = io.read_runs(spark, str(tmp_path / "runs_*.csv"), reports.RUNS_SCHEMA)
    assert {r.combo for r in read.collect()} == {"p2_s3", "p4_s4"} and read.count() == 4
    grams = reports.timed_grams(quantile.assign(table, c := quantile.boundaries(table, "text", 3)), "text", reports.metrics.prefix_report(quantile.assign(table, c), "text", c), c, 0, 1)
    assert {"ngram", "match_count", "time_full_ms", "time_fp_ms", "speedup"} <= set(grams.columns)


def test_fallback_views_settings_and_cleanup(spark, table, tmp_path):
    codes = io.load_boundaries(spark, str(tmp_path / "none"), io.radix_boundaries("text", 8))
    for r in quantile.assign(table.limit(11), codes).collect():
        assert r.q8_prefix == ((r.text or "").lower().encode() + b"\0")[0]
    table.write.parquet(str(tmp_path / "t_one"))
    io.view(spark, str(tmp_path / "t_one"), "one", ["text"])
    assert spark.sql("SELECT count(*) FROM one").first()[0] == 2000
    before = io.session_settings(spark, spark__sql__shuffle__partitions="3")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and io.session_settings(spark, **before)
    assert len(io.clean(spark, str(tmp_path / "t_*"))) == 1 and not (tmp_path / "t_one").exists()


def test_features_equal_brute_force(spark):
    import math

    texts = ["the cat", "a cat", "the dog", "dogs", "cathedral", "", "x", "tea", "teatime"]
    found = bitmask.select_features(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", "id", 4, 2).grams
    grams = sorted({t[i : i + 2] for t in texts for i in range(len(t) - 1)})
    groups, chosen = [list(texts)], []
    for _ in range(4):
        best = None
        for place, group in enumerate(groups):
            for g in grams:
                share = sum(g in t for t in group) / len(group) if group else 0
                score = round(-(share * math.log2(share) + (1 - share) * math.log2(1 - share)) * len(group), 9) if 0 < share < 1 else 0
                if g not in chosen and score > 0 and (best is None or (-score, place, g) < best):
                    best = (-score, place, g)
        _, place, g = best
        chosen.append(g)
        group = groups.pop(place)
        groups += [[t for t in group if g not in t], [t for t in group if g in t]]
    assert list(found) == chosen


def test_ranked_percentiles_equal_numpy(spark):
    import numpy as np

    from codesieve.operators import stats

    rng = np.random.default_rng(1)
    groups = {"ties": rng.integers(0, 5, 900).astype(float), "wide": rng.normal(size=800) * 10 ** rng.integers(0, 9, 800), "one": np.array([3.5]), "same": np.full(50, -2.0)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("none", None), ("ties", None)], "g string, v double")
    at = (0.0, 0.1, 0.5, 0.973, 1.0)
    got = {r.g: r.q for r in stats.ranked_percentiles(df, "v", at, "g", bins=16).collect()}
    assert set(got) == set(groups) and all(np.allclose(got[k], np.quantile(v, at)) for k, v in groups.items())
    assert np.allclose(stats.ranked_percentiles(df, "v", at).first().q, np.quantile(np.concatenate(list(groups.values())), at))


def test_row_numbers_equal_sorting(spark):
    from codesieve.operators import stats

    keys = [(a, b) for a in (None, -70_000, 0, 1, 65_535, 65_536, 200_000) for b in (None, -1, 0, 3, 4_095, 4_096, 9_000)] + [(1, 3), (None, None)]
    rows = [(*k, i) for i, k in enumerate(sorted(keys, key=lambda k: hash((k, 5))))]
    df = spark.createDataFrame(rows, "a long, b long, i int").repartition(5)
    want = sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))
    assert sorted((r.cs_row, r.a, r.b, r.i) for r in stats.row_numbers(df, "a", "b", "i").collect()) == [(n, *r) for n, r in enumerate(want)]


def test_group_sweep_of_several_files_equals_sql(spark, tmp_path):
    import duckdb

    from codesieve import catalog

    # Twelve files whose rows lie in no order, with a long conversation and nulls.
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    more = spark.range(9000).selectExpr("5000L as conv_id", "id as turn", "'user' as role", "if(id % 37 = 0, 'nothing', 'the ending of another python test') as text")
    odd = spark.createDataFrame([(None, 1, "user", "ing"), (7, None, "user", None), (-3, 0, "user", "the")], talk.schema)
    talk.union(more).union(odd).repartition(12, F.hash("turn", "conv_id")).write.parquet(str(tmp_path / "conversations.parquet"))
    assert len(list((tmp_path / "conversations.parquet").glob("*.parquet"))) == 12
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = ["pattern", "group_rows", "groups_total", "groups_skipped", "groups_loaded"]
    got = catalog.queries()["group_sweep"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.oracle_sql()["group_sweep"]).select(*names).fetchall())
