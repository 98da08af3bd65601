import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, make_docs

from rubric.llm import hashing, quality, queries, toxicity
from rubric.llm.labelled import training_rows

SF = "/root/testdata/sf0.01"


def test_word_hashes_against_plain_words(monkeypatch):
    monkeypatch.setattr(hashing, "CHUNK", 7)
    r = random.Random(1)
    texts = ["".join(r.choice("abAB é1.-\n") for _ in range(r.randint(0, 30))) for _ in range(200)] + ["", "z" * 100, "ab"]
    data, begins = hashing.flat(pa.array(["skipped", *texts])[1:])
    w = hashing.words(data, begins, hashing.NOT_SPACE, (2,))
    plain = [(i, x) for i, t in enumerate(texts) for x in t.lower().encode().split()]
    assert w.doc.tolist() == [i for i, _ in plain]
    by_word, by_start = {}, {}
    for (_, x), h, p in zip(plain, w.hash.tolist(), w.prefixes[0].tolist()):
        assert by_word.setdefault(x, h) == h
        assert by_start.setdefault(x[:2], p) == p if len(x) > 1 else p == 0
    assert len(set(by_word.values())) == len(by_word) and len(set(by_start.values())) == len(by_start)


def test_pairs_are_learnt_that_single_weights_miss():
    """Label 1 needs both terms; either alone is harmless."""
    r = np.random.default_rng(0)
    has = r.random((600, 2)) < 0.5
    y = (has[:, 0] & has[:, 1]).astype(float)
    noise = r.integers(10, 500, (600, 5))
    doc = np.concatenate([np.flatnonzero(has[:, 0]), np.flatnonzero(has[:, 1]), np.repeat(np.arange(600), 5)])
    term = np.concatenate([np.full(has[:, 0].sum(), 1), np.full(has[:, 1].sum(), 2), noise.ravel()])
    model = toxicity.fit(y, doc, term)
    both, first, second = model.scores(3, np.array([0, 0, 1, 2]), np.array([1, 2, 1, 2]))
    assert both > 0.9 and first < 0.2 and second < 0.2
    at = np.searchsorted(model.terms, [1, 2])
    assert model.v[at[0]] @ model.v[at[1]] > 0


def test_all_terms_that_go_with_the_label_stay():
    y, terms = np.repeat([1.0, 0.0], 20), np.arange(10, 6010)
    doc = np.repeat(np.arange(20), len(terms))
    assert toxicity.screen(y, doc, np.tile(terms, 20)).tolist() == terms.tolist()


def test_pair_sum_is_the_sum_over_pairs():
    r = np.random.default_rng(1)
    v = r.normal(size=(6, 3))
    pair, _ = toxicity._pairs(2, np.array([0, 0, 0, 0, 1, 1]), v)
    assert np.allclose(pair, [sum(v[i] @ v[j] for i in range(4) for j in range(i)), v[4] @ v[5]])


def test_ordered_thresholds_and_grades():
    r = np.random.default_rng(2)
    z = r.normal(size=900)
    x = np.zeros((900, quality.WIDTH), np.float32)
    x[:, 3] = z
    y = np.digitize(z + r.logistic(size=900) * 0.1, [-1, 0, 1]) * 2 - 1  # grades -1, 1, 3, 5
    model = quality.fit(x, y)
    assert model.lowest == -1 and model.grades == [1, 3, 5] and (np.diff(model.thresholds) > 0).all()
    tails = model.tails(x)
    assert (np.diff(tails, axis=1) <= 0).all()
    expected = model.expected(tails)
    assert np.corrcoef(expected, y)[0, 1] > 0.9 and expected.min() >= -1 and expected.max() <= 5
    assert (model.tail(tails, -1) == 1).all() and (model.tail(tails, 6) == 0).all()
    assert (model.tail(tails, 2) == tails[:, 1]).all()


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_training_rows(spark):
    docs = make_docs(spark, [(i, f"text {i}") for i in range(60)] + [(3, "text 3"), (None, "x"), (7, None)])
    labels = labels_of(spark, [(i, 1, i % 2, "clash") for i in range(50)] + [(3, 1, 1, None), (None, 1, 1, None), (51, None, None, None)])
    rows = training_rows(docs, labels, labels["toxic"], 1000).collect()
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r.text for r in rows) == sorted(f"text {i}" for i in ids)
    assert {r.label for r in rows if r.text == "text 3"} <= {1}
    assert training_rows(docs, labels, labels["toxic"], 10).count() == 10


@pytest.mark.parametrize("labelled", [[], [(1, 1, 0, None)], [(1, None, None, None), (None, 0, 1, None)]])
def test_without_labels_nothing_is_rejected(spark, edge, labelled):
    labels = labels_of(spark, labelled)
    model = toxicity.train(edge, labels)
    assert {r.predicted for r in toxicity.score(edge, model).collect()} == {0}
    assert toxicity.keep_clean(edge, model).count() == edge.count()
    graded = quality.train(edge, labels, quality.graded(labels))
    assert all(r.kept for r in quality.rate(edge, graded).collect())
    assert quality.keep_good(edge, graded).columns == edge.columns


def test_empty_tables(spark, empty, edge):
    labels = labels_of(spark, [(1, 0, 1, None), (3, 1, 0, None), (4, 1, 0, None)])
    for docs in (empty, edge):
        model, graded = toxicity.train(docs, labels), quality.train(docs, labels, quality.graded(labels))
        assert toxicity.score(empty, model).collect() == [] and quality.rate(empty, graded).collect() == []
        assert toxicity.keep_clean(empty, model).collect() == [] and quality.keep_good(empty, graded).collect() == []


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in queries.table(spark, SF, "labels").collect()}
    rows = [r for r in queries.op9_toxicity(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id].toxic for r in rows) >= 0.92 * len(rows)
    rows = [r for r in queries.op2_quality(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.kept == bool(truth[r.doc_id].quality) for r in rows) >= 0.95 * len(rows)
    good = [r for r in rows if truth[r.doc_id].quality]
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def test_a_models_score_ignores_ids_and_order(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    a = toxicity.train(docs, labels, max_rows=200)
    b = toxicity.train(docs.repartition(5), labels.repartition(3), max_rows=200)
    assert a.terms.tolist() == b.terms.tolist() and a.w.tolist() == b.w.tolist()
    scores = toxicity.text_scores(a, pa.array([LONG, "", "idiot"]))
    assert scores.shape == (3,) and ((0 <= scores) & (scores <= 1)).all()


def test_the_fit_of_quality_holds_its_rows_twice_at_most(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 2)
    rng = np.random.default_rng(3)
    rows = [(int(k % 3), sorted(set(rng.integers(0, quality.WIDTH, 20).tolist()))) for k in range(1200)]

    def batches(rows):
        return [pa.RecordBatch.from_arrays([pa.array([y for y, _ in some], pa.int32()), pa.array([a for _, a in some], pa.list_(pa.int32())),
                                            pa.array([[0.5 + y + i / 7 for i in a] for y, a in some], pa.list_(pa.float32()))], ["label", "at", "x"])
                for some in (rows[i:i + 100] for i in range(0, len(rows), 100))]

    given, turned = batches(rows), batches(rows[::-1])
    tracemalloc.start()
    model = next(quality._fit_rows(iter(given)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.7 * len(rows) * quality.WIDTH * 4
    assert model.equals(next(quality._fit_rows(iter(turned))))
