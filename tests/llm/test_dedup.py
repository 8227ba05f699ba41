"""Jaccard join, suffix dedup, line dedup and components against brute force and SQL."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codesieve.llm import components, induced_sort, jaccard_join, line_dedup, suffix_dedup
from codesieve.llm.common import Saved


def word(r):
    return "".join(r.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(r.randint(1, 4)))


def make_rows():
    """Random texts with copies, near copies, shared passages and lines, ties, nulls and a long text."""
    r = random.Random(5)
    passage, line = " ".join(word(r) for _ in range(60)), " ".join(word(r) for _ in range(9))
    rows = []
    for i in range(160):
        words_ = [word(r) for _ in range(r.choice([0, 1, 2, 4, 5, 9, 40, 120, 300]))]
        if rows and r.random() < 0.5 and rows[-1][1]:
            words_ = r.choice(rows)[1].split(" ") if r.random() < 0.7 else rows[-1][1].split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                words_[r.randrange(len(words_))] = word(r)
        text = " ".join(words_)
        if r.random() < 0.2:
            text += "\n" + passage
        if r.random() < 0.3:
            text = "\n".join([line, line, text, "", line, words_[0] if words_ else "x"])
        rows.append((i * 3 % 160, text))
    hub = " ".join(word(r) for _ in range(100))
    for i in range(40):  # a group of near copies that link by chains and hubs
        own = hub.split(" ")
        for _ in range(i % 5):
            own[r.randrange(100)] = word(r)
        rows.append((200 + i, " ".join(own)))
    long_text = "\n".join(" ".join(word(r) for _ in range(20)) for _ in range(600))
    rows += [(300, long_text), (301, long_text[5000:]), (302, long_text), (303, ""), (304, None), (None, passage), (None, long_text), (5, rows[8][1]), (5, rows[8][1]), (306, " \t\n "), (307, "a" * 300), (308, "a" * 120), (309, "A b"), (310, "a  B")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", k) for k, (i, t) in enumerate(make_rows())]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, row int").repartition(3, "row").cache()


def shingle_sets(rows, width):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute_classes(rows, width, percent, roots=False):
    sets = shingle_sets(rows, width)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[root(i)].append(doc)
    out = [(doc, len(s), doc if not s else min(ids[root(i)], default=None)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]
    return (out, {root(i) for i, s in enumerate(sets) if s}) if roots else out


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_classes_equal_brute_force(docs, width, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, jaccard_join.classes(docs, width, percent).collect()), key=repr)
    assert got == sorted(brute_classes(rows, width, percent), key=repr)


def test_signatures_meet_for_every_similar_pair():
    """The pigeonhole, on random pairs just within the bound, with and without spare units."""
    rng = np.random.default_rng(3)
    for percent in (60, 80, 85):
        plan = jaccard_join.bands(percent, 2000)
        for _ in range(400):
            n = int(rng.integers(1, 60)) if rng.random() < 0.7 else int(rng.integers(60, 900))
            m = int(rng.integers(n, n * 100 // percent + 1))
            common = min(n, -(-percent * (n + m) // (100 + percent)))
            if 100 * common < percent * (n + m - common):
                continue
            tokens = rng.integers(0, 2**63, n + m - common, dtype=np.uint64)
            a, b = np.unique(tokens[:n]), np.unique(np.concatenate([tokens[:common], tokens[n:]]))
            sig, who, role = (np.concatenate(x) for x in zip(*(jaccard_join.signatures([a, b], plan, own) for own in (True, False)), strict=True))
            assert jaccard_join.grouped(sig, who, role), (percent, n, m, common)


def test_representatives(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found, roots = brute_classes(rows, 5, 80, roots=True)
    classes = {(d, t): c for (d, t), (_, _, c) in zip(rows, found, strict=True)}
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len([1 for d, t in got if (t or "").split()]) == len(roots)
    assert all(classes[x] == x[0] for x in got) and sum(not (t or "").split() for _, t in got) == sum(not (t or "").split() for _, t in rows)


def test_texts_with_one_number_are_told_apart(spark, monkeypatch):
    """As if SHA-256 began alike for many texts."""
    few = lambda text: (int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % 3, int(hashlib.sha256(text.encode()).hexdigest()[15:30], 16))
    second = jaccard_join.SECOND
    monkeypatch.setattr(jaccard_join, "numbers_of", few)
    monkeypatch.setattr(jaccard_join, "nodes_of", lambda texts, twice: np.array([second | b if a in twice else a for a, b in map(few, texts)], np.int64))

    def column(text, twice):
        a, b = (F.conv(F.substring(F.sha2(text.cast("binary"), 256), at, 15), 16, 10).cast("long") for at in (1, 16))
        return F.when((a % 3).isin(*twice), b.bitwiseOR(F.lit(second))).otherwise(a % 3) if twice else a % 3

    monkeypatch.setattr(jaccard_join, "node_column", column)
    rows = [(i, t) for i, (_, t) in enumerate(make_rows()[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.classes(docs).collect())) == sorted(brute_classes(rows, 5, 80))
    assert {r.doc_id for r in jaccard_join.representatives(docs).collect()} >= {d for d, n, c in brute_classes(rows, 5, 80) if d == c and n}


def test_components_of_chains(spark, docs):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(149, 200), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long"), Saved(spark)).collect()))
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys([*range(100, 150), 200], 100)}


def test_suffix_array_equals_sorting():
    r = random.Random(3)
    for _ in range(60):
        letters = r.choice([1, 2, 3, 200])
        pieces = [bytes(r.randrange(letters) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 12))]
        pieces.append(pieces[0][:5] + pieces[-1])
        n = len(pieces)
        text = np.array([x for i, p in enumerate(pieces) for x in [*(n + b for b in p), n - 1 - i]], np.int64)
        order, common = induced_sort.suffix_array(text, n, 50, memory=r.choice([4, 1 << 20]))
        listed = text.tolist()
        assert order.tolist() == sorted(range(len(listed)), key=lambda i: listed[i:])
        for i in range(1, len(listed)):
            a, b = listed[order[i - 1] :], listed[order[i] :]
            assert min(common[i], 50) == min(50, next(k for k in range(len(listed)) if a[k] != b[k]))


def brute_cut(rows, length=50):
    order = {d: (d is None, d or 0) for d, _ in rows}
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            least[s] = min(least.get(s, (True, 1)), order[d])
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < (order[d] if d is not None else (True, 0)):
                gone[k : k + length] = True
        gone = gone[:-1]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_suffix_dedup_equals_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_cut(rows)
    got = sorted(map(tuple, suffix_dedup.counts(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == sorted((x[:5] for x in want), key=repr)
    assert sum(x[2] > 0 for x in want) > 50
    out = suffix_dedup.rewrite(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect() if r.doc_id is not None) == sorted((x[0], x[5].decode(errors="ignore")) for x, (_, t) in zip(want, rows, strict=True) if x[0] is not None and (x[5].decode(errors="ignore") or not x[2]))


def test_line_dedup_equals_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(line_dedup.ORACLE_SQL)
    names = sorted(want.columns)
    got = sorted((tuple(r[n] for n in names) for r in line_dedup.counts(docs).collect()), key=repr)
    assert got == sorted((tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall()), key=repr)
    assert sum(r.n_removed > 0 for r in line_dedup.counts(docs).collect()) > 10


def test_lines_by_hand(spark):
    run, passage = "one\ntwo\nthree", "a line of more than thirty-two characters"
    df = spark.createDataFrame([(1, f"a\n{run}\nb", "k"), (2, f"c\n\n{run}\nd", "k"), (3, run, "k"), (4, "one\nx\ntwo", "k"), (5, None, "k"), (6, "same\nsame\nsame\nsame\nsame", "k"), (7, "lone", "k"), (8, "lone", "k"), (9, f"p\n{passage}\nq", "k"), (10, f"r\n{passage}", "k")], "doc_id long, text string, cs_name string")
    out = line_dedup.rewrite(df)
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"a\n{run}\nb", 2: "c\n\nd", 3: "", 4: "one\nx\ntwo", 5: None, 6: "same", 7: "lone", 8: "", 9: f"p\n{passage}\nq", 10: "r"}
    assert out.columns == df.columns and line_dedup.rewrite(df.limit(0)).count() == 0
    assert {r.doc_id for r in line_dedup.rewrite(df, emptied=False).collect()} == {1, 2, 4, 5, 6, 7, 9, 10}


def test_runs_that_the_first_place_lacks(spark):
    """A pair of lines stands first in one document; two others share a longer run around it."""
    longer = "w\nx\nhot one\nhot two\ny\nz"
    df = spark.createDataFrame([(1, "a\nhot one\nhot two\nb"), (2, f"c\n{longer}\nd"), (3, f"e\n{longer}\nf")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.rewrite(df).collect()}[3] == "e\nf"


def brute_runs(rows, window=line_dedup.WINDOW, long=line_dedup.LONG):
    """Numbers of the non-blank lines to delete by (doc_id, text), from the definition, place by place."""
    seen, gone = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).digest())):
        own = [x for x in text.split("\n") if x.strip(" ")]
        off = set()
        for p in range(len(own)):
            for size, key in ((1, ("line", own[p]) if len(own[p]) >= long else None), (window, ("run", *own[p : p + window]) if p + window <= len(own) else None), (len(own), ("all", *own) if p == 0 and len(own) < window else None)):
                if key in seen:
                    off.update(range(p, p + size))
                if key:
                    seen.add(key)
        gone[doc_id, text] = off
    return gone


def test_line_dedup_equals_the_definition(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = brute_runs(rows)
    got = {(r.doc_id, r.n_removed) for r in line_dedup.counts(docs).collect()}
    assert got == {(k[0], len(v)) for k, v in want.items()} and sum(map(len, want.values())) > 500


def brute_lines(rows):
    """Texts by (doc_id, text) less each non-blank line that an earlier document, or the same one further up, has."""
    seen, kept = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest())):
        out = []
        for line in text.split("\n"):
            if not line.strip(" ") or line not in seen:
                out.append(line)
            seen.add(line)
        kept[doc_id, text] = "\n".join(out)
    return kept


def test_pipeline_lines_equal_brute_force_over_all_lines(spark):
    hot, longer = "hot one\nhot two", "w\nx\nhot one\nhot two\ny\nz"
    texts = ["a\nlong shared line\nb", "c\nlong shared line\nd", hot, f"e\n{longer}\nf", f"g\n{longer}\nh", "long shared line", "q\n\nq"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 10, t) for i, (_, t) in enumerate(make_rows()) if t and t.strip()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    assert want[1, texts[1]] == "c\nd" and want[4, texts[4]] == "g\nh"
    got = {(r.doc_id, r.text) for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert got == {(k[0], v) for k, v in want.items() if any(x.strip(" ") for x in v.split("\n"))}


def test_native_plan(docs):
    plan = line_dedup.rewrite(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(docs):
    none = docs.limit(0)
    assert jaccard_join.classes(none).count() == suffix_dedup.counts(none).count() == line_dedup.counts(none).count() == 0


def test_clashing_columns(docs):
    names = ["node", "t", "component_id", "h", "cs_id", "cs_t", "cs_gone", "cs_lines", "cs_removed", "CS_node", "cs_own", "cs_text", "cs_bytes", "cs_doc", "cs_once", "cs_n", "xcs_id"]
    odd = docs.withColumns({c: F.lit(k) for k, c in enumerate(names)})
    for table in (jaccard_join.representatives(odd), suffix_dedup.rewrite(odd), line_dedup.rewrite(odd)):
        assert table.columns == odd.columns and table.where("cs_id <> 4 or xcs_id <> 16").count() == 0 and table.count() > 50
