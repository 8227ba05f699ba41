"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold[k] - score), with one weight vector over hashed text features
shared by all grades and thresholds in order. The model gives the expected grade and the tail
probability P(grade >= g) by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm import ngram_features as features
from codesieve.llm.common import lean, view
from codesieve.llm.ngram_features import one_task, parts, rated_sample

#: Rated documents that a model is fitted on, at most.
SAMPLE = 8192
BITS = 15
#: Bytes of text whose features are held at a time.
PART_BYTES = 1 << 20


@dataclass(frozen=True)
class Ordinal:
    """Weights, and a threshold between each two neighbouring grades; grades are values in ascending order."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for each k from 1, as columns."""
        return logistic(score[:, None] - self.thresholds[None, :])

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.at_least(score) @ np.diff(self.grades).astype(float)


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, ratings: np.ndarray, bits: int = BITS, rounds: int = 150, ridge: float = 1e-3, rate: float = 0.2) -> Ordinal:
    """Maximum likelihood with a small ridge, by Adam over all rows (ratings; row, column and value of their features) in each round.

    Without rows, or with one grade only, every document has that grade (0 without rows).
    """
    grades = np.unique(ratings) if len(ratings) else np.zeros(1, np.int64)
    size = features.size(bits)
    if len(grades) == 1:
        return Ordinal(np.zeros(size), np.zeros(0), grades)
    y, n, k = np.searchsorted(grades, ratings), len(ratings), len(grades) - 1
    below = np.array([np.clip((y <= j).mean(), 1e-3, 1 - 1e-3) for j in range(k)])
    start = np.log(below / (1 - below))
    # The thresholds are the first one and the logarithms of the gaps, so they stay in order.
    theta = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, gaps = theta[:size], np.exp(theta[size + 1 :])
        cuts = theta[size] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, values * w[columns], n)
        upper = np.where(y < k, logistic(cuts[np.minimum(y, k - 1)] - score), 1.0)
        lower = np.where(y > 0, logistic(cuts[np.maximum(y - 1, 0)] - score), 0.0)
        up, low = upper * (1 - upper), lower * (1 - lower)
        p = np.maximum(upper - lower, 1e-9)
        by_score = (up - low) / p / n  # of the loss, -log p
        slope = np.zeros_like(theta)
        slope[:size] = np.bincount(columns, by_score[rows] * values, size) + ridge * w / 10
        by_cut = np.bincount(y[y < k], -(up / p)[y < k], k)[:k] + np.bincount(y[y > 0] - 1, (low / p)[y > 0], k)[:k]
        slope[size] = by_cut.sum() / n
        for j in range(1, k):
            slope[size + j] = by_cut[j:].sum() / n * gaps[j - 1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Ordinal(theta[:size], theta[size] + np.concatenate([[0], np.cumsum(np.exp(theta[size + 1 :]))]), grades)


def train(docs: DataFrame, ratings: DataFrame, column: str = "quality", most: int = SAMPLE, bits: int = BITS) -> Ordinal:
    """The model of the ratings in `column` of (doc_id, column), fitted in one task on a bounded sample, to which alone rows are sent; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for part in parts(batches, PART_BYTES):
            rows, columns, values = features.table(part.column("text"), bits)
            found.append((rows + n, columns, values, np.asarray(part.column("rating"))))
            n += part.num_rows
        rows, columns, values, ratings = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(4))
        model = fit(rows, columns, values, ratings.astype(np.int64), bits)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tolist()], "thresholds": [model.thresholds.tolist()], "grades": [model.grades.tolist()]})

    row = one_task(rated_sample(docs, ratings, column, most)).mapInArrow(lean(run), "weights array<double>, thresholds array<double>, grades array<long>").first()
    return Ordinal(np.array(row.weights), np.array(row.thresholds), np.array(row.grades, np.int64)) if row else fit(*[np.zeros(0, np.int64)] * 4, bits)


def score(docs: DataFrame, model: Ordinal, grade: int | None = None, least: float = 0.5, bits: int = BITS) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade >= `grade`), the model's second grade unless given) and keep (tail >= least).

    One row for each row of docs; a null or empty text is scored by its thresholds and repetition alone.
    """
    wanted = model.grades[min(1, len(model.grades) - 1)] if grade is None else grade
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        place = int(np.searchsorted(own.grades, wanted))
        for part in parts(batches, PART_BYTES):
            at = features.scores(own.weights, part.column("text"), bits)
            tails = np.concatenate([np.ones((len(at), 1)), own.at_least(at), np.zeros((len(at), 1))], axis=1)
            tail = tails[:, min(place, len(own.grades))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.expected(at)), pa.array(tail), pa.array(tail >= least)], ["doc_id", "expected_grade", "tail", "keep"])

    return view(docs).mapInArrow(lean(run), "doc_id long, expected_grade double, tail double, keep boolean")


def select(docs: DataFrame, model: Ordinal, grade: int | None = None, least: float = 0.5, bits: int = BITS) -> DataFrame:
    """The rows of docs, with all their columns, whose tail probability is at least `least`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    wanted = model.grades[min(1, len(model.grades) - 1)] if grade is None else grade
    if len(model.grades) < 2:
        return docs if wanted <= model.grades[0] else docs.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        place = int(np.searchsorted(own.grades, wanted))
        for batch in batches:
            for part in parts([batch], PART_BYTES):
                texts = pa.array(part.column("text")).fill_null("")
                at = features.scores(own.weights, texts, bits)
                tails = np.concatenate([np.ones((len(at), 1)), own.at_least(at), np.zeros((len(at), 1))], axis=1)
                yield part.filter(pa.array(tails[:, min(place, len(own.grades))] >= least))

    return docs.mapInArrow(lean(run), docs.schema)
