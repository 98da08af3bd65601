import numpy as np
import pytest

from rubric.llm import queries, whitening

SMALL = "/root/testdata/sf0.001"


def brute(rows, steps=256, k=4):
    """vec_id -> (deviation, whitened) lists, with n, explained; numpy over all rows at once."""
    ids = [i for i, _ in rows]
    x = np.floor(steps * np.array([v for _, v in rows], dtype=float))
    distinct = np.unique(x, axis=0)
    n, total = len(distinct), distinct.sum(axis=0)
    off = distinct - total / n
    covariance = off.T @ off / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:k]
    z = (x - total / n) @ vectors[:, order] / np.sqrt(values[order])
    far = [sum(int(n * a - s) ** 2 for a, s in zip(row, total)) for row in x]
    return ids, n, far, z, values[order] / np.trace(covariance)


def same(got, rows, k=4):
    ids, n, far, z, explained = brute(rows, k=k)
    assert len(got) == len(rows) * k
    for c in range(1, k + 1):
        mine = sorted((r.vec_id if r.vec_id is not None else -1, r.deviation, r.whitened) for r in got if r.component == c)
        want = sorted(zip((-1 if i is None else i for i in ids), far, z[:, c - 1].tolist()))
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        a, b = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
        if not np.allclose(a, b, atol=1e-9):  # either sign, and rows that repeat an id in either order
            b = np.array([w[2] for w in sorted(zip((-1 if i is None else i for i in ids), far, (-z[:, c - 1]).tolist()))])
        assert np.allclose(a, b, atol=1e-9)
        assert all(r.explained == pytest.approx(explained[c - 1], rel=1e-9) for r in got if r.component == c)
    assert all(r.n == n and r.identity_error < 1e-9 for r in got)


def test_whole_table_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 37)  # many blocks, the last of each partition filled up
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, SMALL, "embeddings").collect()]
    same(queries.op12_whitening(spark, SMALL).collect(), rows)


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    good = [(int(i), [float(v) for v in rng.normal(size=5)]) for i in range(40)]
    good += [(7, [9.0, 1.0, 2.0, 3.0, -4.0]), (None, [0.5] * 5), (3, good[5][1]), (100, good[5][1]), (101, [-0.0] * 5), (102, [0.0] * 5)]
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] + [0.0] * 4),
           (204, [float("inf")] + [0.0] * 4), (205, [1.0, 2.0])]
    extra = "block string, x string, z string, n string"
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in good + bad], f"vec_id long, embedding array<float>, {extra}").repartition(3)
    exact = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in good]
    same(whitening.whiten(df).collect(), exact)


def test_tables_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [
        (i, c, 1, 0, None, None, 0.0) for i in (1, 2) for c in (1, 2)]
    # Three points on a line: the second component has no variance, the first has all of it.
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(3)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert {round(r.explained, 9) for r in line} == {1.0, 0.0} and all(r.identity_error < 1e-9 for r in line)


def test_deviations_beyond_doubles_are_exact():
    x = np.array([[3_000_000_000, 1], [-1, 7]])
    total = [2_999_999_999, 8]
    assert whitening.deviations(x, 2, total) == [sum((2 * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]


def test_blocks_get_longer_instead_of_more():
    assert whitening.block_rows(10) == whitening.BLOCK_ROWS
    assert -(-10 ** 12 // whitening.block_rows(10 ** 12)) <= whitening.BLOCKS
