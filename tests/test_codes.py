"""Codes never lose a match; boundaries, masks and features are the same whatever the partitions."""

from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.functions import keys
from codesieve.operators import bitmask, patterns, quantile
from codesieve.plans import timing
from codesieve.plans.predicates import Index, Match, accelerate, like

#: Edge cases of keys: empty, short, 7 to 9 bytes, cut characters, last bytes 0x7F and 0xBF, four bytes, combining, wildcards, repeats.
STRINGS = [None, "", "a", "ab", "abcdefg", "abcdefgh", "abcdefghi", "abcdefgé", "éab", "ÿ", "ÿa", "¿", "a\x7f", "a߿", "😀x", "éa", "AbC", "aBc", "100%", "a_b", "a\\b", "it's", "the end", "the end", "the end", "THE cat", "theme", "İx", "ΑΣ"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)], "id int, text string").cache()


def low(spark, s):
    return spark.range(1).select(F.lower(F.lit(s))).first()[0]


@pytest.mark.parametrize("bits", [1, 4, 8, 12])
@pytest.mark.parametrize("method", ["lower", "linear"])
def test_ranges_hold_every_match(spark, table, bits, method):
    for suffix in (False, True):
        codes = quantile.boundaries(table, "text", bits, suffix, method)
        assert list(codes.boundaries) == sorted(codes.boundaries) and len(codes.boundaries) == 1 << bits
        for row in quantile.assign(table, codes).select("text", F.lower("text").alias("low"), codes.name).collect():
            code, text = row[codes.name], row.low or ""
            assert 0 <= code < 1 << bits
            for n in range(min(len(text), 11) + 1):
                pattern = text[len(text) - n :] if suffix else text[:n]
                lo, hi = codes.range(pattern)
                assert lo <= code <= hi, (text, pattern)


def test_all_assignments_agree(spark, table):
    codes = quantile.boundaries(table, "text", 8)
    own = {r.id: r.q8_prefix for r in quantile.assign(table, codes).collect()}
    expected = {r.id: max(0, bisect_right(codes.boundaries, r.k) - 1) for r in table.select("id", keys.key(F.col("text")).alias("k")).collect()}
    edges = quantile.boundary_table(spark, codes).select(F.col("key").alias("k"))
    assert own == expected == {r.id: r.c for r in quantile.assign_sorted(table, edges, codes, "c").collect()}


def test_key_order_is_byte_order(spark, table):
    got = {r.text: r.k for r in table.select("text", keys.key(F.col("text")).alias("k")).collect() if r.text}
    for s, k in got.items():
        assert k == low(spark, s).encode()[:8].hex().upper().ljust(16, "0")


def test_all_equal_and_empty_tables(spark):
    same = spark.createDataFrame([("x",)] * 20, "text string")
    codes = quantile.boundaries(same, "text", 4)
    assert {r[0] for r in quantile.assign(same, codes).select(codes.name).collect()} == {15}
    none = spark.createDataFrame([], "text string")
    assert quantile.boundaries(none, "text", 4).range("a") == (15, 15)


def test_accelerated_equals_plain(spark, table):
    p, s = quantile.boundaries(table, "text", 4), quantile.boundaries(table, "text", 4, suffix=True)
    df = quantile.pack(quantile.assign(quantile.assign(table, p), s), p, s)
    features = bitmask.Features(("th", "he", "a_", "0%"), 2)
    df = df.withColumn(features.name, features.column(F.col("text"))).cache()
    for a, b, c in (("the", "", ""), ("", "d", ""), ("a", "b", ""), ("éab", "", ""), ("", "", "the"), ("1", "%", "0%"), ("ÿ", "", ""), ("", "", "")):
        m = Match("text", prefix=a, suffix=b, inside=c)
        want = sorted(r.id for r in df.where(m.exact()).collect())
        for index, way in ((Index(p, s), "range"), (Index(p, s, "q16_infix"), "range"), (Index(p, s, "q16_infix"), "shift"), (Index(p, s, "q16_infix"), "in"), (Index(features=features), "range")):
            assert sorted(r.id for r in accelerate(df, m, index, way).collect()) == want


def test_like_patterns():
    assert like("c", "a%") == Match("c", prefix="a") and like("c", "%a") == Match("c", suffix="a") and like("c", "%a%") == Match("c", inside="a")
    assert like("c", "a_b%") is None and like("c", "a%b") is None and like("c", "a") is None


def test_code_range_is_pushed_and_comes_first(spark, table, tmp_path):
    codes = quantile.boundaries(table, "text", 4)
    quantile.assign(table, codes).write.parquet(str(tmp_path / "t"))
    df = accelerate(spark.read.parquet(str(tmp_path / "t")), Match("text", prefix="the"), Index(codes))
    assert "GreaterThanOrEqual(q4_prefix" in str(timing.pushed(df)) and "LessThanOrEqual(q4_prefix" in str(timing.pushed(df))
    condition = next(line for line in timing.plan(df).splitlines() if "Condition" in line)
    assert condition.index("q4_prefix") < condition.index("StartsWith")


def test_features_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat", "a cat", "the dog", "dogs", "cathedral", "", None, "x"])], "id int, text string")
    found = {bitmask.select_features(df.repartition(n), "text", "id", 4, 2).grams for n in (1, 2, 8)}
    assert len(found) == 1
    features = bitmask.Features(found.pop(), 2)
    for r in df.withColumn("m", features.column(F.col("text"))).collect():
        text = r.text or ""
        for i in range(len(text)):
            for j in range(i, len(text) + 1):
                mask = features.mask(text[i:j])
                assert r.m & mask == mask
    assert bitmask.Features.from_json(features.to_json()) == features
    assert bitmask.Features.from_json('{"selected_chars": ["a"]}') == bitmask.Features(("a",), 1)
    with pytest.raises(ValueError):
        bitmask.select_features(df.where("id = 7"), "text", "id", 4, 2)


def test_linear_boundaries_are_numpy_percentiles(spark):
    df = spark.createDataFrame([(chr(97 + i),) for i in range(20)], "text string")
    codes = quantile.boundaries(df, "text", 2, method="linear")
    values = np.array([(97 + i) << 56 for i in range(20)], np.float64)
    assert [int(x, 16) for x in codes.boundaries] == np.percentile(values, [0, 25, 50, 75]).astype(np.uint64).tolist()


@pytest.mark.parametrize("method", ["lower", "linear"])
def test_boundaries_rank_all_rows(spark, method):
    # More rows than any sample that boundaries were once taken from, a third of them one value.
    df = spark.range(600_000).select(F.when(F.col("id") % 3 == 0, F.lit("many")).otherwise(F.substring(F.md5(F.col("id").cast("string")), 1, 5)).alias("text"))
    all_keys = np.array(sorted(r[0] for r in df.select(keys.key(F.col("text"))).collect()))
    for bits in (1, 8, 11):
        at = np.arange(1 << bits)
        if method == "lower":
            want = all_keys[at * (len(all_keys) - 1) >> bits].tolist()
        else:
            values = np.percentile(np.array([int(k, 16) for k in all_keys], np.uint64), at * 100 / (1 << bits))
            want = [f"{int(x):016X}" for x in np.maximum.accumulate(values.astype(np.uint64))]
        assert list(quantile.boundaries(df, "text", bits, method=method).boundaries) == want


def test_allocation_takes_no_more_than_there_is(spark):
    df = spark.createDataFrame([("1", i) for i in range(30)] + [("2-5", i) for i in range(3)], "b string, i int")
    got = {r.b: r.allocated for r in patterns.allocation(df, "b", 20, 5, [x for _, x in patterns.SPAN_BINS]).collect()}
    assert got == {"1": 5 + 12 * 30 // 33, "2-5": 3}
