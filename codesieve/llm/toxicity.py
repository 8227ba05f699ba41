"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents, a bounded sample of them, are the positives; all documents, whatever their rating, are the
unlabelled set, as the risk estimator needs texts of the whole population there. A linear
model over the presence of words minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), the
class-prior-corrected risk whose negative part can't fall below zero: there its slope counts no more. The class prior is the
share of toxic documents among the rated ones, or less if the words that tell positives show that there are fewer in the corpus.

Words are chosen by their document counts in the positives and in the whole corpus, which one pass adds up. A second
pass reduces every document to the chosen words that it has, and equal ones to their number; these few rows are saved, and
the steps of the fit sum the risk and its slope over them where they lie. So no document is left out at any size, and no task or the
driver holds more than the words' weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import Saved, flat, row_sums, view, words
from codesieve.llm.ngram_features import parts

#: Confirmed positives that a model is fitted on, and words that it looks at, at most: those that most positives have; and the bytes of a word.
POSITIVES, VOCABULARY, LONGEST = 4096, 1 << 20, 64
#: A word stands in so many positives at least.
LEAST = 3
#: ASCII punctuation counts as white space. A fixed list.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


@dataclass(frozen=True)
class Toxic:
    """A weight for each word of the vocabulary, for its presence, and a bias."""

    vocabulary: list[str]
    weights: np.ndarray
    bias: float


def present(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words without punctuation, and the words present in each row (each once)."""
    import pyarrow.compute as pc

    plain = pc.replace_substring_regex(flat(column), PUNCTUATION, " ")
    dictionary, codes, starts = words(pc.utf8_lower(plain), lower=False)
    rows, size = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), max(1, len(dictionary))
    pairs = np.unique(rows * size + codes)
    return dictionary, pairs % size, np.searchsorted(pairs, np.arange(len(starts)) * size)


def informative(inside: np.ndarray, total: np.ndarray, positives: int, everything: int) -> np.ndarray:
    """The words whose presence tells positives from all documents by the G statistic, in order.

    inside, total: positives and documents that have each word.
    """
    p, n, both = positives, positives + everything, inside + total

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    g = 2 * (part(inside, both * p / n) + part(total, both * everything / n) + part(p - inside, (n - both) * p / n) + part(everything - total, (n - both) * everything / n))
    # With so many words looked at, chance alone reaches 2 log(size); a word must do clearly better.
    return np.flatnonzero((inside >= LEAST) & (g > 2 * np.log(max(len(inside), 2)) + 6))


def corpus_prior(inside: np.ndarray, total: np.ndarray, positives: int, everything: int, labelled: float, least: int = 10) -> float:
    """The share of toxic documents: `labelled`, or less.

    A word that a share of the positives has stands in that share of all toxic documents at least, so its share of the corpus over
    that of the positives bounds the prior. The words of `least` positives that agree with the lowest bound, within two standard errors, are pooled.
    """
    some = np.flatnonzero(inside >= least)
    if not len(some):
        return labelled
    ratio = total[some] / everything / (inside[some] / positives)
    near = some[ratio <= (ratio * (1 + 2 / np.sqrt(inside[some]))).min()]
    return float(min(labelled, max(1e-4, total[near].sum() / everything / (inside[near].sum() / positives))))


#: Risk of a batch of documents (sets of word numbers): see `risk`.
Sums = tuple[float, float, float, np.ndarray, np.ndarray]


def risk(theta: np.ndarray, codes: np.ndarray, at: np.ndarray, unlabelled: np.ndarray, positive: np.ndarray) -> Sums:
    """Sums over documents, so many times unlabelled and positive: the negative loss of either, the positive loss of positives, and the slopes (last: bias) of the unlabelled's and the positives' negative loss."""
    size = len(theta) - 1
    score = row_sums(theta[codes], at) + theta[size]
    loss, chance = np.logaddexp(0, score), 0.5 * (1 + np.tanh(score / 2))
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    slopes = [np.append(np.bincount(codes, (chance * n)[rows], size), (chance * n).sum()) for n in (unlabelled, positive)]
    return (loss * unlabelled).sum(), (loss * positive).sum(), (np.logaddexp(0, -score) * positive).sum(), *slopes


def fit(sums: Callable[[np.ndarray], Sums], present: np.ndarray, prior: float, n_unlabelled: float, n_positive: float, rounds: int = 60, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by limited-memory quasi-Newton steps on the non-negative risk with the logistic loss.

    sums: `risk` over all documents at given weights and bias. present: how many positives have each word.
    """
    size = len(present)
    here = np.append(present, n_positive) / max(n_positive, 1)

    def value(theta: np.ndarray) -> tuple[float, np.ndarray, bool]:
        u, p, plus, u_slope, p_slope = sums(theta)
        u, p, plus, u_slope, p_slope = u / n_unlabelled, prior * p / n_positive, prior * plus / n_positive, u_slope / n_unlabelled, prior * p_slope / n_positive
        decay = ridge * np.append(theta[:size], 0)
        # d/dz of log(1 + exp(-z)) is the chance less one.
        rising = p_slope - prior * here
        return plus + max(0.0, u - p) + 0.5 * (decay * theta).sum(), rising + (u_slope - p_slope if u >= p else 0) + decay, u < p

    theta = np.zeros(size + 1)
    theta[size] = np.log(prior / (1 - prior))
    now, slope, below = value(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, memory = slope.copy(), []
        for s, y in reversed(steps):
            memory.append((s @ direction) / (s @ y))
            direction -= memory[-1] * y
        direction *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.abs(slope).max(), 1e-12)
        for (s, y), a in zip(steps, reversed(memory), strict=True):
            direction += s * (a - (y @ direction) / (s @ y))
        length = 1.0
        while True:
            new = theta - length * direction
            then, new_slope, new_below = value(new)
            if then <= now or length < 1e-6:
                break
            length /= 4
        if then > now:
            break
        change, bend = new - theta, new_slope - slope
        # The slope jumps where the negative part crosses zero, so what was learnt on the other side goes.
        steps = [] if below or new_below else steps
        if change @ bend > 1e-12:
            steps = [*steps[-9:], (change, bend)]
        gain, theta, now, slope, below = now - then, new, then, new_slope, new_below
        if np.abs(slope).max() < 1e-6 or abs(gain) < 1e-5:
            break
    return theta[:size], float(theta[size])


def numbered(column: pa.Array | pa.ChunkedArray, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the known words present in each row, in order, and where each row's start."""
    dictionary, codes, at = present(column)
    known = np.fromiter((number.get(w, -1) for w in dictionary.to_pylist()), np.int64, len(dictionary))[codes]
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))[known >= 0]
    known = known[known >= 0]
    by = np.lexsort((known, rows))
    return known[by], np.searchsorted(rows, np.arange(len(at)))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, vocabulary: int = VOCABULARY) -> Toxic:
    """The model of `labels` (doc_id, toxic): positives have toxic 1 in some row.

    The positives are a bounded sample, the lowest hashes of doc_id; of rows that share a doc_id the least text counts. All rows of docs are the unlabelled
    set. Without positives the model has no words and its score is near 0.
    """
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = rated.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("p")).first()
    prior = min(max(counts.p / max(counts.n, 1), 1e-4), 0.5)
    nothing = Toxic([], np.zeros(0), float(np.log(prior / (1 - prior))))
    spark, own, saved = docs.sparkSession, view(docs), Saved(docs.sparkSession)
    chosen = rated.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id")
    confirmed = saved.save(own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "confirmed")
    n_positive = confirmed.count()

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            dictionary, codes, _ = present(part.column("text"))
            yield pa.RecordBatch.from_arrays([dictionary.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(dictionary)))], ["word", "n"])

    looked = confirmed.select("text").mapInArrow(words_of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST) & (F.octet_length("word") <= LONGEST))
    looked = looked.orderBy(F.desc("n"), "word").limit(vocabulary).collect()  # VOCABULARY words of LONGEST bytes at most
    if not looked:
        saved.drop(confirmed)
        return nothing
    names, inside = [r.word for r in looked], np.array([r.n for r in looked], float)
    held = spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(held.value), np.int64), 0
        for part in parts(batches):
            codes, _ = numbered(part.column("text"), held.value)
            total += np.bincount(codes, minlength=len(total))
            n += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["word", "n"])

    found = own.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(len(names))
    total[found.word[found.word >= 0].to_numpy()] = found.n[found.word >= 0]
    everything = int(found.n[found.word < 0].sum())
    best = informative(inside, total, n_positive, everything)
    if not len(best):
        saved.drop(confirmed)
        return nothing
    kept = spark.sparkContext.broadcast({names[i]: k for k, i in enumerate(best)})

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for part in parts(batches):
            codes, at = numbered(part.column("text"), kept.value)
            codes = codes.astype("<i4")
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                key = codes[a:b].tobytes()
                seen[key] = seen.get(key, 0) + 1
            if len(seen) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()))], ["words", "n"])
                seen = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["words", "n"])

    every, sure = (x.select("text").mapInArrow(patterns, "words binary, n long") for x in (own, confirmed))
    both = every.select("words", F.col("n").alias("u"), F.lit(0).cast("long").alias("p")).union(sure.select("words", F.lit(0).cast("long"), "n"))
    reduced = saved.save(both.groupBy("words").agg(F.sum("u").alias("u"), F.sum("p").alias("p")), "patterns")

    def sums(theta: np.ndarray) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                lists = [np.frombuffer(x, "<i4") for x in batch.column("words").to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                one = risk(theta, np.concatenate(lists).astype(np.int64), at, np.asarray(batch.column("u"), float), np.asarray(batch.column("p"), float)) if lists else None
                out = one if out is None else tuple(a + b for a, b in zip(out, one, strict=True)) if one else out
            if out:
                flat_out = np.concatenate([out[:3], out[3], out[4]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat_out))), pa.array(flat_out)], ["i", "x"])

        rows = reduced.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        x = np.zeros(3 + 2 * len(theta))
        x[rows.i.to_numpy()] = rows.x
        return x[0], x[1], x[2], x[3 : 3 + len(theta)], x[3 + len(theta) :]

    prior = corpus_prior(inside[best], total[best], n_positive, everything, prior)
    weights, bias = fit(sums, inside[best], prior, everything, n_positive)
    saved.drop(confirmed, reduced)
    return Toxic([names[i] for i in best], weights, bias)


def score(docs: DataFrame, model: Toxic, least: float = 0.7) -> DataFrame:
    """doc_id, score (probability of toxic, 0 to 1) and predicted (1 if score >= least) for each row of docs.

    A null or empty text has the score of no words, which the bias alone gives.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        weight = dict(zip(own.vocabulary, own.weights.tolist(), strict=True))
        for part in parts(batches):
            dictionary, codes, at = present(part.column("text"))
            known = np.fromiter((weight.get(w, 0.0) for w in dictionary.to_pylist()), float, len(dictionary))
            chance = 0.5 * (1 + np.tanh((row_sums(known[codes], at) + own.bias) / 2))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(chance), pa.array((chance >= least).astype(np.int32))], ["doc_id", "score", "predicted"])

    return view(docs).mapInArrow(run, "doc_id long, score double, predicted int")
