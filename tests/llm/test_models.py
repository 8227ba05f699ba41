"""Quality, toxicity, language model and fingerprints: definitions, held-out accuracy and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import context_tree, fingerprints, quality, toxicity
from codesieve.llm import ngram_features as features
from codesieve.llm.common import fold

SF = "/root/testdata/sf0.01"
EDGES = [(None, "no id"), (-1, None), (-2, ""), (-3, " \n "), (-4, "x" * 100_000), (-5, "twice"), (-5, "twice")]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return real.union(spark.createDataFrame(EDGES, "doc_id long, text string")).withColumn("score", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").union(spark.createDataFrame([(None, 1, 1), (-5, None, None)], "doc_id long, quality int, toxic int"))


def test_quality_on_rated_documents(docs, labels):
    model = quality.train(docs, labels)
    assert model.grades.tolist() == [0, 1] and len(model.thresholds) == 1
    out = quality.score(docs, model)
    assert out.count() == docs.count()
    rated = out.join(labels.where("doc_id >= 0"), "doc_id").toPandas()
    assert ((rated["tail"] >= 0.5) == (rated["quality"] == 1)).mean() > 0.95
    assert out.where("isnan(tail) or tail < 0 or tail > 1").count() == 0
    kept = quality.select(docs, model)
    assert kept.columns == docs.columns and kept.count() == out.where("keep").count()
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_without_ratings(docs, labels):
    model = quality.train(docs, labels.limit(0))
    assert {r.tail for r in quality.score(docs, model).collect()} == {1.0} and quality.select(docs, model).count() == docs.count()


def test_ordinal_thresholds_are_ordered_and_held_out_grades_follow():
    rng = np.random.default_rng(1)
    n, bits = 600, 8
    truth = rng.normal(size=n)
    grades = np.digitize(truth + 0.1 * rng.normal(size=n), [-1, 0, 1])
    shares = (rng.random((n, 40)) < 1 / (1 + np.exp(-2 * truth[:, None]))).mean(axis=1)
    half = n // 2
    rows, columns = np.repeat(np.arange(half), 2), np.tile([5, 9], half)
    model = quality.fit(rows, columns, np.column_stack([shares, 1 - shares])[:half].ravel(), grades[:half], bits)
    assert (np.diff(model.thresholds) > 0).all() and model.grades.tolist() == [0, 1, 2, 3]
    score = shares[half:] * model.weights[5] + (1 - shares[half:]) * model.weights[9]
    tails = model.at_least(score)
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    assert np.corrcoef(model.expected(score), grades[half:])[0, 1] > 0.85


def test_quality_held_out(docs, labels):
    """Accuracy on documents whose ratings the model has not seen."""
    out = quality.score(docs, quality.train(docs, labels.where(~fold(3, 1)))).join(labels.where(fold(3, 1)), "doc_id").toPandas()
    assert len(out) > 50 and ((out["tail"] >= 0.5) == (out["quality"] == 1)).mean() > 0.93


def test_only_the_sample_goes_to_one_task(spark, labels):
    plan = features.one_task(features.rated_sample(spark.read.parquet(f"{SF}/documents.parquet"), labels, "quality", 100))._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" not in plan and plan.index("Exchange SinglePartition, REPARTITION_BY_NUM") < plan.index("Join") < plan.rindex("FileScan")


def test_features_and_scores_agree():
    import pyarrow as pa

    texts = pa.array(["", "one", "the cat and the hat", "été!!! $$$ x", "a" * 5000])
    weights = np.random.default_rng(5).normal(size=features.size(8))
    rows, columns, values = features.table(texts, 8)
    assert np.allclose(np.bincount(rows, values * weights[columns], len(texts)), features.scores(weights, texts, 8))


def test_toxicity_held_out(docs, labels):
    model = toxicity.train(docs, labels.where(~fold(3, 1)))
    out = toxicity.score(docs, model)
    assert out.count() == docs.count()
    found = out.join(labels.where("doc_id >= 0"), "doc_id").toPandas()
    held = found[[zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]]
    assert held[held.toxic == 0].predicted.mean() < 0.03 and held[held.toxic == 1].predicted.mean() > 0.6
    assert {r.predicted for r in out.where("doc_id < 0 or doc_id is null").collect()} == {0}
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_positive_unlabelled_risk_finds_the_marker():
    rng = np.random.default_rng(2)
    toxic = rng.random(3000) < 0.1
    rows = [np.unique(np.append(rng.integers(1, 30, 8), 0 if t else 1)) for t in toxic]
    known = toxic & (rng.random(3000) < 0.5)
    use = [rows[i] for i in np.flatnonzero(known)] + rows
    positive = np.append(np.ones(known.sum(), bool), np.zeros(3000, bool))
    at = np.cumsum([0, *map(len, use)])
    codes, unlabelled = np.concatenate(use), 1.0 - positive
    weights, bias = toxicity.fit(lambda theta: toxicity.risk(theta, codes, at, unlabelled, positive.astype(float)), np.bincount(codes[np.repeat(positive, np.diff(at))], minlength=30), 0.1, 3000, positive.sum())
    chance = np.array([1 / (1 + math.exp(-weights[x].sum() - bias)) for x in rows])
    assert ((chance > 0.7) == toxic).mean() > 0.98


def brute_ctw(train, text, depth):
    """log10 probability of a text's words under frozen context trees of training texts, by recursion over explicit counts."""
    counts: dict = {}

    def steps(text_words):
        line = [32] * depth + [x for w in text_words for x in [*w, 32]] + [0xFF]
        for i in range(depth, len(line)):
            context = tuple(line[i - depth : i][::-1])
            for k in range(8):
                yield context, (1 << k) | line[i] >> (8 - k), line[i] >> (7 - k) & 1

    for words_ in train:
        for context, v, bit in steps(words_):
            for d in range(depth + 1):
                counts.setdefault((context[:d], v), [0, 0])[bit] += 1
    kids: dict = {}
    for context, v in counts:
        if context:
            kids.setdefault((context[:-1], v), []).append((context, v))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo: dict = {}

    def weighted(node):
        if node not in memo:
            own = kt(*counts[node])
            memo[node] = own if len(node[0]) == depth else np.logaddexp(own, sum(weighted(k) for k in kids[node])) - math.log(2)
        return memo[node]

    def chance(context, v, d):
        a, b = counts[context[:d], v]
        own = (b + 0.5) / (a + b + 1)
        if d == depth or (context[: d + 1], v) not in counts:
            return own
        share = math.exp(kt(a, b) - math.log(2) - weighted((context[:d], v)))
        return share * own + (1 - share) * chance(context, v, d + 1)

    total = 0.0
    for context, v, bit in steps(text):
        p = chance(context, v, 0) if ((), v) in counts else 0.5
        total += math.log10(p if bit else 1 - p)
    return total


@pytest.mark.parametrize("depth", [3, 7])
def test_scores_equal_recursion(spark, depth):
    texts = ["the cat and the hat", "the  cat\nsat", "", None, "été été THE", "an ananan an", "the cat and the hat", "unseenword the zz", "hat the and cat the", "x" * 300]
    rows = [(i, t, i % 3 == 2) for i, t in enumerate(texts)]
    out = context_tree.score(spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(3), F.col("doc_id") % 3 == 2, depth).collect()
    spelled = [(t or "").encode().lower().split() for t in texts]
    train = [w for w, (_, _, h) in zip(spelled, rows, strict=True) if not h]
    for r in out:
        want = brute_ctw(train, spelled[r.doc_id], depth)
        assert r.score == pytest.approx(want, abs=r.n_bytes / context_tree.SCALE), r.doc_id
        assert r.n_bytes == len(b"".join(w + b" " for w in spelled[r.doc_id])) + 1 and r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)


def test_word_order_counts(spark):
    rows = [(i, "one two three four five six seven") for i in range(20)] + [(100, "one two three four five six seven"), (101, "five one seven two six three four")]
    got = {r.doc_id: r.score for r in context_tree.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert got[100] > 0.5 * got[101]


def test_symbol_probabilities_add_up_to_one():
    rng = np.random.default_rng(3)
    # Every symbol in each of some contexts, few of them seen.
    contexts = rng.integers(97, 100, (40, 7)).astype(np.uint64)
    numbers = np.unique(sum(contexts[:, k] << np.uint64(8 * k) for k in range(7)))
    keys = (numbers[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()
    counts = rng.integers(0, 5, len(keys)) * (rng.random(len(keys)) < 0.02)
    top = context_tree.Top(*context_tree.top_rows(keys, counts, 7))
    chance = 10 ** context_tree.symbol_costs(keys, counts, top, 7)
    assert np.allclose(chance.reshape(-1, 256).sum(axis=1), 1)


def test_lists_travel_whole():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (context_tree.unrising(context_tree.rising(x)) == x).all() and (context_tree.unpacked(context_tree.packed(x)) == x).all()
        distinct = np.unique(x)
        assert (context_tree.Lookup(distinct).find(x) == np.searchsorted(distinct, x)).all()


def test_language_model_rows(docs):
    out = context_tree.score(docs, fold(7, 2)).toPandas()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter(w for i, t in rows if not held(i) for w in [*t, b"\xff"])
    n, v = sum(train.values()), len(train)
    want = sorted((-9 if i is None else i, held(i), len(t) + 1, sum(w in train for w in [*t, b"\xff"]), n, round(sum(math.log10((train.get(w, 0) + 1) / (n + v + 1)) for w in [*t, b"\xff"]), 4)) for i, t in rows)
    got = sorted((int(r.doc_id) if r.doc_id == r.doc_id else -9, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out.itertuples())
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=1e-6, atol=1e-3)
    assert (out.score < 0).all() and out.score.sum() > out.base_score.sum()
    # On texts that the model has not seen too.
    assert out.score[out.held_out].sum() > out.base_score[out.held_out].sum()
    assert context_tree.score(docs.limit(0), fold(7, 2)).count() == 0


def test_language_model_without_training_texts(docs):
    out = context_tree.score(docs.where("doc_id < 0"), F.lit(True)).toPandas()
    assert (out.train_tokens == 0).all() and (out.n_known == 0).all() and np.isfinite(out.score).all()


def test_prefix_hashes():
    r = random.Random(4)
    for _ in range(60):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 60)))
        b = a[: r.randint(0, 60)] + "".join(r.choice("ab") for _ in range(r.randint(0, 20)))
        x, y = fingerprints.Prefixes(fingerprints.code_points(a)), fingerprints.Prefixes(fingerprints.code_points(b))
        for _ in range(20):
            i, j, k = r.randint(0, len(a)), r.randint(0, len(b)), r.randint(0, 20)
            inside = i + k <= len(a) and j + k <= len(b)
            assert x.equal(i, y, j, k) == (inside and a[i : i + k] == b[j : j + k])
            want = next((m for m in range(min(len(a) - i, len(b) - j)) if a[i + m] != b[j + m]), min(len(a) - i, len(b) - j))
            assert x.extension(i, y, j) == want
        keep, most = r.randint(0, len(a)), r.randint(0, 40)
        joined = fingerprints.Prefixes(fingerprints.code_points(a[:keep] + b[:most]))
        assert x.followed_by(keep, y, most).fingerprint() == joined.fingerprint()
        assert fingerprints.likeness(x.fingerprint(), x.fingerprint()) == 1 and 0 <= fingerprints.likeness(x.fingerprint(), y.fingerprint()) <= 1


def test_likeness_follows_what_is_shared():
    r = random.Random(6)
    a = "".join(r.choice("abcdef ") for _ in range(4000))
    other = "".join(r.choice("abcdef ") for _ in range(4000))
    near = lambda x, y: fingerprints.likeness(*(fingerprints.Prefixes(fingerprints.code_points(s)).fingerprint() for s in (x, y)))
    assert near(a, other) == 0 and near(a, "") == 0
    assert near(a, a[:2000] + other[:2000]) == pytest.approx(0.5, abs=0.07)
    assert near(a, a[:1000] + "zz" + a[1002:]) > 0.85


def test_likeness_counts_the_middle():
    r = random.Random(7)
    near = lambda x, y: fingerprints.likeness(*(fingerprints.Prefixes(fingerprints.code_points(s)).fingerprint() for s in (x, y)))
    for n, least in ((300, 0.6), (3000, 0.9), (2040, 0.85), (200_000, 0.998)):
        a = "".join(r.choice("abcdefé ") for _ in range(n))
        b = a[:20] + "ZZZZ" + a[24 : n - 20] + "Y" + a[n - 16 :]
        assert least < near(a, b) < 1 and near(a, b) == near(b, a)
        assert near(a, "Z" + a[: n // 2] + "YY" + a[n // 2 :] + "X") > least  # shifted, so that nothing stands where it stood
        assert near(a, "".join(r.choice("abcdefé ") for _ in range(n))) < 0.05
    assert near("x" * 100_000, "y" + "x" * 99_998 + "y") > 0.99 and near("", "") == 1


def test_pieces_cover_the_text():
    r = random.Random(8)
    for n in (0, 1, 7, 8, 9, 40, 700):
        for letters in ("a", "ab", "abcdefgh"):
            text = "".join(r.choice(letters) for _ in range(n))
            own = fingerprints.Prefixes(fingerprints.code_points(text))
            for reach in (4, 16):
                h = [int(own.spans(np.array([i]), np.array([i + 8]))[0, 0]) for i in range(n - 7)]
                chosen = {i for i in range(len(h)) if all(h[i] < x for x in h[max(0, i - reach) : i] + h[i + 1 : i + 1 + reach])}
                cuts = own.cuts(reach).tolist()
                assert cuts[0] == 0 and cuts[-1] == n and cuts == sorted(cuts) and chosen <= set(cuts)
                assert all(0 < y - x <= 255 for x, y in zip(cuts, cuts[1:], strict=False))


def test_hot_ids_are_dealt_to_several_parts(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{i * 7919 % 1000:03d} text") for i in range(900)]
    dealt = fingerprints.next_in_order(spark.createDataFrame(rows, "doc_id long, text string"), 12)
    found = [tuple(r) for r in dealt.collect()]
    order = sorted(found, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [r[2] for r in order] == sorted(r[2] for r in order)
    sizes = Counter(r[2] for r in found)
    assert len({r[2] for r in found if r[0] is None}) > 2 and len({r[2] for r in found if r[0] == 7}) > 2 and max(sizes.values()) < 250


def test_fingerprint_rows(spark, docs):
    sub = docs.where("doc_id is not null and doc_id <> -4")
    got = {(r.doc_id, r.fingerprint): r for r in fingerprints.compare(sub).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in sub.collect()), key=lambda x: (-x[0], x[1]))
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        tail = len(text) // 2
        edited = text[: len(text) - tail] + following[:tail]
        r = got[doc, fingerprints.Prefixes(fingerprints.code_points(text)).fingerprint()]
        if doc != -5:
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            own, changed, after = (fingerprints.Prefixes(fingerprints.code_points(x)).fingerprint() for x in (text, edited, following))
            assert r.edited_fingerprint == changed and r.near_edited == fingerprints.likeness(own, changed) and r.near_next == fingerprints.likeness(own, after)
            # No more than what the two texts have in common, each code point as often as both have it.
            both = sum((Counter(text) & Counter(following)).values())
            assert text == following or r.near_next <= both / max(len(text), len(following), 1)
    assert fingerprints.compare(docs.limit(0)).count() == 0
    one = fingerprints.compare(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    assert fingerprints.compare(docs).count() == docs.count()
