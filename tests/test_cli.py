import pytest

from codesieve import cli
from codesieve.sources import io


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "t.tsv").write_text("primaryTitle\n" + "\n".join(["the end", "the cat", "a dog", "dogs", "cathedral", "the dog"] * 5))
    at = lambda name: str(tmp_path / name)
    cli.main(["titles", at("t.tsv"), at("t")])
    cli.main(["build", at("t"), at("b"), "--bits", "3"])
    assert io.load_boundaries(spark, at("b") + ".boundaries").bits == 3
    assert spark.read.parquet(at("b")).columns == ["title", "q3_prefix"]
    assert sum(r.row_count for r in io.read_csv(spark, at("b") + ".buckets", "bucket_id int, row_count long").collect()) == 30
    cli.main(["build-infix", at("t"), at("i"), "--prefix-bits", "4", "--suffix-bits", "4", "--combined"])
    assert spark.read.parquet(at("i")).columns == ["title", "q16_infix"]
    cli.main(["build-substr", at("t"), at("s"), "--bits", "4", "--max-freq", "1.0"])
    cli.main(["scan", at("s"), at("s") + ".features", "--patterns", "the", "dog", "zzz"])
    assert capsys.readouterr().out.count("same") == 3
    cli.main(["report", at("t"), at("r"), "--bits", "3"])
    assert spark.read.option("header", True).csv(at("r")).count() == 4
    cli.main(["pairs", at("t"), at("p"), "--samples", "2", "--warmup", "0", "--reps", "1"])
    assert spark.read.option("header", True).csv(at("p")).count() == 2
    cli.main(["repartition", at("b"), at("q"), "--rows", "10", "--code", "q3_prefix"])
    assert spark.read.parquet(at("q")).count() == 30
    with pytest.raises(SystemExit):
        cli.main(["report", at("t"), at("x"), "--text", "none"])


def test_timed_commands(spark, tmp_path, capsys):
    rows = ["the end", "the cat", "a dog", "dogs", "cathedral", "the dog", "ind on", "as"] * 5
    spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "n int, title string").coalesce(1).write.parquet(str(tmp_path / "t"))
    at = lambda name: str(tmp_path / name)
    quick, csv = ["--warmup", "0", "--reps", "1"], lambda name: spark.read.option("header", True).csv(at(name))
    cli.main(["build-substr", at("t"), at("s"), "--bits", "4", "--max-freq", "1.0"])
    for choice in ("random", "rows", "stratified"):
        cli.main(["pairs", at("t"), at(f"p_{choice}"), "--samples", "3", "--choice", choice, *quick])
        assert 0 < csv(f"p_{choice}").count() <= 3 and csv(f"p_{choice}").where("same <> 'true'").count() == 0
    cli.main(["compare", at("t"), at("c"), "--prefix-bits", "3", "--suffix-bits", "3", *quick])
    cli.main(["six-way", at("t"), at("x"), "--prefix-bits", "3", "--suffix-bits", "3", "--samples", "2", *quick])
    assert csv("c").count() == len(cli.FIXED_PAIRS) and csv("x").count() == 2
    cli.main(["profile", at("t"), at("f.csv"), "--patterns", "the", "a", *quick])
    assert csv("f_profiles.csv").count() == 2
    cli.main(["infix-sweep", at("t"), at("runs"), "--bits", "2,2", "3,3", *quick])
    cli.main(["summarise", at("runs_p*.csv"), at("sum")])
    cli.main(["summarise", at("runs_p*.csv"), at("sum")])
    assert csv("sum").count() == 2 * 2 * len(cli.FIXED_PAIRS)
    cli.main(["bit-sweep", at("t"), at("bits"), "--patterns", "the", "--bits", "2", "3", *quick])
    cli.main(["segments", at("t"), at("seg"), "n", "--patterns", "the", "zz", "--bits", "1", "3", "--rows", "10"])
    cli.main(["substrings", at("s"), at("s") + ".features", at("sub"), "--samples", "2", *quick])
    cli.main(["group-sweep", at("s"), at("s") + ".features", at("g"), "--patterns", "the", "dog", "--rows", "5", "10"])
    cli.main(["report", at("t"), at("r"), "--bits", "3", "--reps", "1"])
    assert csv("bits").count() == 4 and csv("seg").count() == 4 and csv("g").count() == 4 and csv("sub").count() > 6 and "speedup" in csv("r").columns
    cli.main(["scan", at("s"), at("s") + ".features", "--patterns", "the", "--output", at("scan"), "--group-rows", "10"])
    assert csv("scan").first()["groups_total"] == "4"
    cli.main(["clean", at("p_*")])
    assert not (tmp_path / "p_rows").exists()
