"""Toxicity: a factorization machine over hashed terms.

A document is the set of its terms: words and word beginnings of 4, 5 and 6
bytes (endings vary), hashed to ``SPACE`` classes.  The score is

    sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>)

over its terms; the second sum takes O(terms * FACTORS) steps, and learns
pairs that mean more together than their weights say, such as an insult and
a group's name.

Fitting sees a bounded sample (``MAX_ROWS`` documents).  Its terms are
screened first: those whose own link with the label is stronger than chance
stay, however many; all other terms weigh nothing, so pairs of which neither
term alone goes with the label are not learnt.  A model has the terms of the
sample at most, ``SPACE`` of them, and scoring is a narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import ALNUM, blocks, flat, words
from .labelled import held_out, training_rows
from .rows import project, python_ready

SPACE = 1 << 20
PREFIXES = (4, 5, 6)
#: Labelled documents that fitting looks at.
MAX_ROWS = 12_000
#: Fixed value: the chi-square statistic that one term in ten thousand exceeds by chance.
CHANCE = 15.14
FACTORS = 8
STEPS = 200
THRESHOLD = 0.5


def term_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, term), each pair once, sorted."""
    data, begins = flat(texts)
    w = words(data, begins, ALNUM, PREFIXES)
    pairs = []
    for h in (w.hash, *w.prefixes):
        has = h > 0
        pairs.append((w.doc[has].astype(np.int64) * SPACE) + (h[has] >> np.uint64(44)).astype(np.int64))
    pairs = np.unique(np.concatenate(pairs))
    return pairs // SPACE, pairs % SPACE


@dataclass
class Model:
    """``terms``: sorted; ``w`` and ``v``: their weights and factors."""

    w0: float
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def scores(self, n: int, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Of ``n`` texts with these (text, term) pairs."""
        if len(self.terms):
            slot = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            known = self.terms[slot] == term
            doc, slot = doc[known], slot[known]
        else:
            doc = slot = np.zeros(0, np.int64)
        z = self.w0 + _sums(n, doc, self.w[slot]) + _pairs(n, doc, self.v[slot])[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sums(n: int, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.bincount(doc, x, n) if x.ndim == 1 else np.stack([np.bincount(doc, c, n) for c in x.T], 1)


def _pairs(n: int, doc: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over pairs, and the sum of the factors, of each text."""
    total = _sums(n, doc, v)
    return (total ** 2).sum(1) / 2 - _sums(n, doc, (v ** 2).sum(1)) / 2, total


def screen(y: np.ndarray, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The terms that go with the label more than by chance, sorted."""
    seen = np.bincount(term, minlength=SPACE).astype(float)
    hits = np.bincount(term, y[doc], SPACE)
    n, pos = len(y), y.sum()
    with np.errstate(all="ignore"):
        chi = (hits * (n - pos - seen + hits) - (seen - hits) * (pos - hits)) ** 2 * n / (
            pos * (n - pos) * seen * (n - seen))
    return np.flatnonzero((seen >= 2) & np.isfinite(chi) & (chi > CHANCE))


def fit(y: np.ndarray, doc: np.ndarray, term: np.ndarray) -> Model:
    """Adam on the logistic loss.  Without rows of both labels: the share of
    label 1, (ones) / (rows + 2), for every text."""
    n, none = len(y), np.zeros(0)
    if not 0 < y.sum() < n:
        share = np.clip(y.sum() / (n + 2), 1e-6, 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), none.astype(np.int64), none, np.zeros((0, FACTORS)))
    terms = screen(y, doc, term)
    known = np.isin(term, terms)
    doc, slot = doc[known], np.searchsorted(terms, term[known])
    rng, m = np.random.default_rng(7), len(terms)
    share = y.mean()
    params = [np.array([np.log(share / (1 - share))]), np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))]
    decay = [0.0, 1e-4, 1e-3]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, STEPS + 1):
        w0, w, v = params
        pair, total = _pairs(n, doc, v[slot])
        z = w0[0] + _sums(n, doc, w[slot]) + pair
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        grads = [np.array([g.sum()]), np.bincount(slot, g[doc], m), _sums(m, slot, g[doc][:, None] * (total[doc] - v[slot]))]
        for i, (p, grad) in enumerate(zip(params, grads)):
            grad = grad + decay[i] * p
            a, b = moments[i]
            a[...] = 0.9 * a + 0.1 * grad
            b[...] = 0.999 * b + 0.001 * grad ** 2
            p -= 0.05 * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    return Model(float(params[0][0]), terms, params[1], params[2])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (label, terms)."""
    for batch in batches:
        _, begins = flat(batch.column(1))
        for first, end in blocks(begins):
            doc, term = term_sets(batch.column(1)[first:end])
            ends = np.searchsorted(doc, np.arange(end - first + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[first:end], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term, pa.int32()))],
                ["label", "terms"])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All (label, terms) -> the model as one row."""
    rows = pa.Table.from_batches(list(batches), pa.schema([("label", pa.int32()), ("terms", pa.list_(pa.int32()))]))
    order = rows.combine_chunks().to_pandas().assign(key=lambda d: d["terms"].map(lambda t: bytes(np.asarray(t, np.int32))))
    order = order.sort_values(["key", "label"], kind="stable")  # the same model in whatever order the rows came
    lists = [np.asarray(t, np.int64) for t in order["terms"]]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    model = fit(order["label"].to_numpy(float), doc, np.concatenate([np.zeros(0, np.int64), *lists]))
    yield pa.RecordBatch.from_pandas(pd.DataFrame({
        "w0": [model.w0], "terms": [model.terms.tolist()], "w": [model.w.tolist()], "v": [model.v.ravel().tolist()]}),
        preserve_index=False)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of ``max_rows`` labelled documents (see ``training_rows``).

    Terms are made where the texts are; one task fits the bounded rest.  The
    model that reaches the driver has the terms that were screened in.
    """
    python_ready(docs.sparkSession)
    rows = training_rows(docs, labels, labels[label_col].cast("int"), max_rows, id_col, text_col)
    terms = rows.mapInArrow(_features, "label int, terms array<int>").repartition(1)
    found = terms.mapInArrow(_fit_rows, "w0 double, terms array<bigint>, w array<double>, v array<double>").first()
    if found is None:
        return fit(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Model(found["w0"], np.array(found["terms"], np.int64), np.array(found["w"]),
                 np.array(found["v"]).reshape(-1, FACTORS))


def text_scores(model: Model, texts: pa.Array) -> np.ndarray:
    _, begins = flat(texts)
    return np.concatenate([np.zeros(0)] + [model.scores(end - first, *term_sets(texts[first:end]))
                                           for first, end in blocks(begins)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (0 or 1).
    A null text counts as empty; one without known terms has the score of ``w0``."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_scores(model, batch.column(1)))],
                                             ["doc_id", "score"])

    scored = project(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``THRESHOLD``.
    Only texts go to Python."""
    python_ready(docs.sparkSession)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(text_scores(model, texts), pa.float64())

    return docs.where(scores(F.coalesce(docs[text_col], F.lit(""))) < THRESHOLD)
