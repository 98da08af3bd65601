"""Quality: ordinal regression on graded ratings over hashed text.

A cumulative-link (proportional odds) model: one weight vector for all
grades and ordered thresholds,

    P(grade >= k) = sigmoid(x . w - threshold_k),  threshold_1 < threshold_2 < ...

Every grade's ratings train the same weights.  A text gets its expected
grade, the sum of these probabilities, and the tail probability of the grade
asked for, by which documents are selected.

``x`` has, hashed to ``SPACE`` classes each: runs of three characters by kind
(letter of either case, digit, each punctuation mark), and words; log
frequencies, so a text's length doesn't matter.  One more says how many words
repeat the word before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import NOT_SPACE, blocks, flat, mix, words
from .labelled import held_out, training_rows
from .rows import project, python_ready

SPACE = 2048
WIDTH = 2 * SPACE + 1
#: Labelled documents that fitting looks at.
MAX_ROWS = 6_000
STEPS = 200
#: The lowest grade that counts as good, and the tail probability from which a document is kept.
GOOD = 1
KEEP = 0.5

#: Kind of a byte: itself, but one kind for small letters (and bytes over 127), capitals and digits.
KIND = np.arange(256, dtype=np.uint8)
KIND[97:123] = KIND[128:] = ord("a")
KIND[65:91] = ord("A")
KIND[48:58] = ord("0")


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each text."""
    n = len(texts)
    data, begins = flat(texts)
    kind = KIND[data].astype(np.uint64)
    text = np.repeat(np.arange(n), np.diff(begins))
    whole = text[:-2] == text[2:]  # three characters of one text
    with np.errstate(over="ignore"):
        three = mix((kind[:-2] << np.uint64(16)) + (kind[1:-1] << np.uint64(8)) + kind[2:])[whole] if len(data) > 2 else kind[:0]
    x = np.zeros((n, WIDTH), np.float32)
    w = words(data, begins, NOT_SPACE)
    repeats = np.zeros(len(w.doc), bool)
    repeats[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    n_words = np.maximum(np.bincount(w.doc, minlength=n), 1)[:, None]
    x[:, :SPACE] = _counts(n, text[:-2][whole], three) / np.maximum(np.diff(begins), 1)[:, None]
    x[:, SPACE:-1] = _counts(n, w.doc, w.hash) / n_words
    x[:, -1:] = np.bincount(w.doc, repeats, n)[:, None] / n_words
    return np.log1p(100 * x)


def _counts(n: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    cells = doc * SPACE + (h >> np.uint64(53)).astype(np.int64)
    return np.bincount(cells, minlength=n * SPACE).reshape(n, SPACE)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Model:
    """``grades``: the grades above the lowest, ascending, with one threshold each."""

    w: np.ndarray
    grades: list[int]
    thresholds: np.ndarray
    lowest: int

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each row and each k of ``grades``."""
        return sigmoid((x @ self.w)[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.lowest + tails @ np.diff([self.lowest, *self.grades])

    def tail(self, tails: np.ndarray, grade: int) -> np.ndarray:
        """P(rating >= grade): that of the next grade that ratings have; 1
        for the lowest and 0 beyond the highest."""
        if grade <= self.lowest:
            return np.ones(len(tails))
        k = int(np.searchsorted(self.grades, grade))
        return tails[:, k] if k < len(self.grades) else np.zeros(len(tails))


def fit(x: np.ndarray, y: np.ndarray, keep: bool = True) -> Model:
    """Adam on the likelihood of the grades ``y`` (whole numbers).  Unless told to ``keep`` it, ``x`` is centred in place.

    The thresholds stay in order because each is the one before plus a
    positive step.  With a single grade or no rows at all there is nothing
    to learn: no weights, and every text has the lowest grade of the sample
    (or ``GOOD``, so that nothing is rejected).
    """
    seen = sorted(set(y.tolist()))
    if len(seen) < 2:
        return Model(np.zeros(WIDTH, np.float32), [], np.zeros(0), int(seen[0]) if seen else GOOD)
    rank = np.searchsorted(seen, y)
    cuts = len(seen) - 1
    above = np.array([(rank >= k).mean() for k in range(1, cuts + 1)])
    first = -np.log(above / (1 - above))
    params = [np.zeros(x.shape[1]), np.append(first[:1], np.log(np.maximum(np.diff(first), 1e-3)))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    n, rows = len(y), np.arange(len(y))
    centre = x.mean(0)
    x = np.subtract(x, centre, out=None if keep else x)
    for t in range(1, STEPS + 1):
        w, steps = params
        thresholds = np.cumsum(np.append(steps[:1], np.exp(steps[1:])))
        tails = np.ones((n, cuts + 2))
        tails[:, 1:-1] = sigmoid((x @ w.astype(np.float32))[:, None] - thresholds)
        tails[:, -1] = 0
        p = np.maximum(tails[rows, rank] - tails[rows, rank + 1], 1e-9)
        slope = tails * (1 - tails)
        to_score = -(slope[rows, rank] - slope[rows, rank + 1]) / p / n
        to_threshold = np.zeros((n, cuts + 2))
        to_threshold[rows, rank] += slope[rows, rank] / p / n
        to_threshold[rows, rank + 1] -= slope[rows, rank + 1] / p / n
        by_threshold = to_threshold[:, 1:-1].sum(0)
        later = np.cumsum(by_threshold[::-1])[::-1]  # a step moves all later thresholds
        grads = [x.T @ to_score.astype(np.float32) + 1e-4 * w,
                 np.append(later[:1], later[1:] * np.exp(steps[1:]))]
        for param, grad, (a, b) in zip(params, grads, moments):
            a[...] = 0.9 * a + 0.1 * grad
            b[...] = 0.999 * b + 0.001 * grad ** 2
            param -= 0.05 * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    w, steps = params
    thresholds = np.cumsum(np.append(steps[:1], np.exp(steps[1:]))) + centre @ w
    return Model(w.astype(np.float32), seen[1:], thresholds, seen[0])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (label, the features that aren't 0: at, x)."""
    for batch in batches:
        _, begins = flat(batch.column(1))
        for first, end in blocks(begins):
            x = features(batch.column(1)[first:end])
            row, at = np.nonzero(x)
            ends = pa.array(np.searchsorted(row, np.arange(end - first + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[first:end], pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(x[row, at], pa.float32()))], ["label", "at", "x"])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All (label, at, x) -> the model as one row."""
    rows = pa.Table.from_batches(list(batches), pa.schema([("label", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))]))
    y, at, values = (c.combine_chunks() for c in rows.columns)
    y, x, row = y.to_numpy(zero_copy_only=False), np.zeros((len(rows), WIDTH), np.float32), np.repeat(np.arange(len(rows)), pc.list_value_length(at))
    x[row, at.flatten().to_numpy()] = values.flatten().to_numpy()
    del rows, row, at, values
    # The same model in whatever order rows came; a label's rows at a time, as keys are copies of them.
    order = [i for label in np.unique(y) for i in sorted(np.flatnonzero(y == label), key=lambda i: x[i].tobytes())]
    x, y = x[order], y[order]
    model = fit(x, y.astype(int), keep=False)
    yield pa.RecordBatch.from_pandas(pd.DataFrame({
        "w": [model.w.tolist()], "grades": [list(map(int, model.grades))], "thresholds": [model.thresholds.tolist()],
        "lowest": [int(model.lowest)]}), schema=pa.schema([("w", pa.list_(pa.float32())), ("grades", pa.list_(pa.int32())),
                                                           ("thresholds", pa.list_(pa.float64())), ("lowest", pa.int32())]))


def graded(labels: DataFrame) -> Column:
    """Grades of the labels table: 0 for low quality, 1 for good quality with
    toxic content, 2 for good quality without; null if quality is."""
    return F.when(labels["quality"] == 0, 0).when(labels["quality"] == 1, F.when(labels["toxic"] == 1, 1).otherwise(2))


def train(docs: DataFrame, labels: DataFrame, grade: Column, max_rows: int = MAX_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of ``max_rows`` labelled documents (see ``training_rows``).
    Features are made where the texts are; one task fits the bounded rest."""
    python_ready(docs.sparkSession)
    rows = training_rows(docs, labels, grade.cast("int"), max_rows, id_col, text_col)
    made = rows.mapInArrow(_features, "label int, at array<int>, x array<float>").repartition(1)
    found = made.mapInArrow(_fit_rows, "w array<float>, grades array<int>, thresholds array<double>, lowest int").first()
    if found is None:
        return fit(np.zeros((0, WIDTH), np.float32), np.zeros(0, int))
    return Model(np.array(found["w"], np.float32), list(found["grades"]), np.array(found["thresholds"]), found["lowest"])


def text_tails(model: Model, texts: pa.Array) -> np.ndarray:
    _, begins = flat(texts)
    return np.concatenate([np.zeros((0, len(model.grades)))] + [
        model.tails(features(texts[first:end])) for first, end in blocks(begins)])


def rate(docs: DataFrame, model: Model, good: int = GOOD, keep: float = KEEP,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, expected_grade, tail
    probability of ``good``, kept.  A null text counts as empty: all
    features 0."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = text_tails(model, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.expected(tails), pa.float64()), pa.array(model.tail(tails, good), pa.float64())],
                ["doc_id", "expected_grade", "tail"])

    rated = project(docs, id_col, text_col).mapInArrow(run, "doc_id long, expected_grade double, tail double")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail",
                        (F.col("tail") >= keep).alias("kept"))


def keep_good(docs: DataFrame, model: Model, good: int = GOOD, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose tail probability reaches
    ``keep``.  Only texts go to Python."""
    python_ready(docs.sparkSession)

    @F.arrow_udf("double")
    def tail(texts: pa.Array) -> pa.Array:
        return pa.array(model.tail(text_tails(model, texts), good), pa.float64())

    return docs.where(tail(F.coalesce(docs[text_col], F.lit(""))) >= keep)
