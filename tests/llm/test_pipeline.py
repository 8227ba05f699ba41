"""The pipeline's stages, each on what the one before has kept, and the guard around the subpackage."""

import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_dedup import brute_classes, brute_cut, brute_lines
from tokenizers import Tokenizer

import corpus_pipeline
from codesieve.llm import quality

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and before * 0.5 < docs.count() <= before
            assert docs.where("n_chars <> char_length(text)").count() == 0 or name == "quality"
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def test_stages_equal_brute_force(spark):
    """Whole stages against the definitions, on real rows with nulls, empty and repeated rows, ties, a long text, and extra columns with names that operators use."""
    r = random.Random(8)
    passage = " ".join(r.choice(["then", "one", "river", "of", "stone", "moved"]) for _ in range(60))
    sentence = "The passage that follows has been printed before, and it will be printed again here."
    odd = [(None, "A text without an id.\nIt has two lines."), (-1, None), (-2, ""), (-3, " \n "), (-4, "Many words of one kind. " * 3000), (-5, sentence), (-5, sentence), (-6, f"Head. {passage} Tail."), (-7, f"Other. {passage} End."), (-8, sentence + " More."), (-9, sentence)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(i, t, "en", "odd", None if t is None else len(t)) for i, t in odd], docs.schema)
    docs = docs.unionByName(extra).withColumns({"node": F.lit(1), "cs_id": F.lit("x"), "component": F.lit(2.5), "block": F.lit(None).cast("string")})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, kept = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == columns and kept.where("node <> 1 or cs_id <> 'x' or component <> 2.5 or block is not null").count() == 0
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)

    rows = [(r.doc_id, r.text or "") for r in quality.select(docs, quality.train(docs, labels)).collect()]
    lined = brute_lines(rows)
    rows = [(d, lined[d, t]) for d, t in rows if not any(x.strip(" ") for x in t.split("\n")) or any(x.strip(" ") for x in lined[d, t].split("\n"))]
    one_of_each = {}
    for (d, t), (_, n, least) in zip(rows, brute_classes(rows, 5, 80), strict=True):
        if n == 0:
            one_of_each[len(one_of_each), "blank"] = (d, t)
        elif d == least:
            one_of_each[d, t] = (d, t)
    rows = list(one_of_each.values())
    left = [(d, cut[5].decode(errors="ignore"), cut[2]) for (d, _), cut in zip(rows, brute_cut(rows), strict=True)]
    assert got == sorted(((d, t) for d, t, gone in left if t or not gone), key=repr)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.sequences(spark, kept, SF).collect()
    ids = {(d, t): np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in got}
    want = []
    for x in [ids[k] for k in got]:
        at = 0
        while at < len(x):
            size = min(2048, 1 << ((len(x) - at).bit_length() - 1))
            want.append((at, size, zlib.crc32(x[at : at + size].tobytes())))
            at += size
    assert sorted((p.start, p.length, p.ids_crc32) for p in pieces) == sorted(want)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_entry_works_without_the_subpackage(tmp_path):
    for p in ("codesieve", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "codesieve/llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and out.stdout.split()[1] == "False", out.stderr


WORKERS = """
import os
import pyarrow as pa
import public_tokenizers
from pyspark.sql import SparkSession
from codesieve.llm import packing, suffix_dedup

def probe(batches):
    # RssAnon in MB of the workers that this one's daemon has, and what this one keeps.
    own = os.getppid()
    pids = open(f"/proc/{own}/task/{own}/children").read().split()
    held = [int(next(x.split()[1] for x in open(f"/proc/{p}/status") if x.startswith("RssAnon"))) // 1024 for p in pids]
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"held": [held], "kept": [len(packing._tokens)]})

spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").cache()
look = lambda: spark.range(1).mapInArrow(probe, "held array<long>, kept long").first()
packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).agg({"ids_crc32": "max"}).collect()
after_packing = look()
suffix_dedup.counts(docs).agg({"n_removed": "sum"}).collect()
after_passages = look()
print("found", after_packing.kept, after_passages.kept, max(after_passages.held), after_packing.held, after_passages.held)
"""


def test_workers_are_left_small():
    """What packing keeps goes with the next operator, and no worker holds on to memory that a task has freed."""
    out = subprocess.run([sys.executable, "-c", WORKERS], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"})
    assert "found " in out.stdout, out.stderr[-2000:]
    packed, later, most = map(int, out.stdout.split("found ")[1].split()[:3])
    assert packed == 1 and later == 0 and most < 100, out.stdout
