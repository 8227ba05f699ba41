import gzip

import pytest
from pyspark.sql import functions as F

from codesieve.operators import bitmask, quantile
from codesieve.sources import io
from codesieve.streaming import encode


def test_titles_from_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write('id\tprimaryTitle\n1\tThe "End\n2\t\\N\n3\tB\n')
    assert [r.title for r in io.read_titles(spark, str(tmp_path / "t.tsv.gz")).collect()] == ['The "End', "B"]


def test_missing_table_says_how_to_build(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="build first"):
        io.read_table(spark, str(tmp_path / "none"), hint="build first")


def test_boundaries_features_and_runs(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "text string")
    codes = quantile.boundaries(df, "text", 2)
    io.save_boundaries(spark, codes, str(tmp_path / "b"))
    assert io.load_boundaries(spark, str(tmp_path / "b")) == codes
    features = bitmask.Features(("é", "b"), 1)
    io.save_features(spark, features, str(tmp_path / "f"))
    assert io.load_features(spark, str(tmp_path / "f")) == features
    for p, s in ((4, 8), (12, 12)):
        (tmp_path / f"runs_p{p}_s{s}.csv").write_text("query,time_s\nfull,1.5\n")
    got = io.read_runs(spark, str(tmp_path / "runs_*.csv"), "query string, time_s double")
    assert sorted((r.combo, r.time_s) for r in got.collect()) == [("p12_s12", 1.5), ("p4_s8", 1.5)]


def test_clustered_write_has_narrow_files(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 100).cast("int").alias("q"))
    io.write_clustered(df, str(tmp_path / "t"), "q", 4, rows=200)
    out = spark.read.parquet(str(tmp_path / "t"))
    assert io.footers(out).agg(F.max("rows")).first()[0] <= 200
    spans = out.groupBy(F.input_file_name()).agg((F.max("q") - F.min("q")).alias("w"))
    assert out.count() == 1000 and spans.agg(F.max("w")).first()[0] <= 30


def test_views(spark):
    io.materialised(spark.range(3), "three")
    assert spark.sql("SELECT count(*) FROM three").first()[0] == 3
    io.drop_view(spark, "three")


def test_stream_codes(spark, tmp_path):
    df = spark.createDataFrame([("the",), ("a",), (None,)], "text string")
    df.write.parquet(str(tmp_path / "in"))
    codes, features = quantile.boundaries(df, "text", 2), bitmask.Features(("th",), 2)
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    encode.write(encode.encoded(stream, [codes], features), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in quantile.assign(df, codes).withColumn("fp16_chars", features.column(F.col("text"))).collect()}
    with pytest.raises(ValueError):
        encode.encoded(stream, [quantile.Codes("text", 21, False, ())])
