import random

import brute
import pytest
from cases import EDGE, make_docs

from rubric.llm import jaccard_join


def near_copies(n, seed=3):
    """Texts around a few bases, with up to a fifth of their words changed."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    bases = [[word() for _ in range(40)] for _ in range(4)]
    rows = []
    for i in range(n):
        words = list(r.choice(bases)) if i % 5 else [word() for _ in range(r.randint(1, 30))]
        for _ in range(r.choice((0, 1, 1, 2, 3, 8))):
            words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    return rows


def check(rows, got, size, percent):
    want = brute.jaccard(rows, size, percent)
    as_key = lambda t: tuple((x is None, x) for x in t)
    assert sorted((as_key((r.doc_id, r.n_shingles, r.component_id)) for r in got)) == sorted(as_key(w[:3]) for w in want)


@pytest.mark.parametrize("size,percent", [(5, 80), (4, 85)])
def test_edge_rows(edge, size, percent):
    check(EDGE, jaccard_join.jaccard_components(edge, size, percent).collect(), size, percent)


def test_every_link_of_near_copies(spark, monkeypatch):
    rows = near_copies(400)
    monkeypatch.setattr(jaccard_join, "GROUP", 8)  # many groups, so most links cross them
    monkeypatch.setattr(jaccard_join, "QUERIES", 5)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)  # all joins by shuffle
    check(rows, jaccard_join.jaccard_components(make_docs(spark, rows), 2, 60).collect(), 2, 60)


def test_empty(empty):
    assert jaccard_join.jaccard_components(empty).collect() == []


def test_one_document_of_each_component(edge):
    got = jaccard_join.one_of_each(edge)
    assert got.columns == edge.columns
    want = brute.jaccard(EDGE, 5, 80)
    stay = set()
    for number in {w[3] for w, (_, t) in zip(want, EDGE) if w[1]}:
        group = [(i is None, i, brute.sha(t)) for (i, t), w in zip(EDGE, want) if w[3] == number]
        stay.add(min(group, key=lambda g: (g[0], g[1] or 0, g[2]))[1:])
    stay |= {(i, brute.sha(t)) for (i, t), w in zip(EDGE, want) if not w[1]}
    rows = [(r.doc_id, brute.sha(r.text)) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == stay


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101)]
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}
