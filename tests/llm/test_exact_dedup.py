import brute
from cases import EDGE
from pyspark.sql import functions as F

from rubric.llm import exact_dedup
from rubric.llm.rows import keep_rows


def key(t):
    return tuple((x is None, str(x)) for x in t)


def test_edge_rows(edge):
    got = [tuple(r)[:5] for r in exact_dedup.exact_dedup(edge).collect()]
    assert sorted(got, key=key) == sorted(brute.exact(EDGE), key=key)


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_directory_doubles_until_buckets_fit(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    rows = exact_dedup.directory(hashes, capacity=100, max_depth=10).collect()
    held = {}
    cells = hashes.groupBy(exact_dedup.cell(F.col("h"), 10).alias("c")).count().collect()
    n = {r["c"]: r["count"] for r in cells}
    assert {r.cell for r in rows} == set(n)
    for r in rows:
        assert r.bucket == r.cell >> (10 - r.depth) << (10 - r.depth)
        held[r.bucket, r.depth] = held.get((r.bucket, r.depth), 0) + n[r.cell]
    assert max(held.values()) <= 100
    for (bucket, depth), _ in held.items():  # no bucket was split without need
        half = 10 - depth + 1
        assert sum(v for c, v in n.items() if c >> half == bucket >> half) > 100


def test_too_full_buckets_stay(spark):
    hashes = spark.range(300).select(F.lit(7).cast("long").alias("h"))
    rows = exact_dedup.directory(hashes, capacity=10, max_depth=4).collect()
    assert [(r.cell, r.depth, r.bucket) for r in rows] == [(0, 4, 0)]


def test_colliding_texts_form_a_chain(spark):
    keyed = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "a", 5), (4, "c", 9)], "doc_id long, text string, h long")
    index, _ = exact_dedup.build_index(keyed)
    rows = index.collect()
    assert sorted((r.h, r.chain) for r in rows) == [(5, 0), (5, 1), (9, 0)]
    assert sorted((r.keep_id, r.group_size) for r in rows) == [(2, 1), (3, 2), (4, 1)]


def test_kept_rows_carry_all_columns(edge):
    kept = keep_rows(edge, exact_dedup.exact_dedup(edge).where("kept"))
    assert kept.columns == edge.columns
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    want = {(i, t or "") for (i, t), e in zip(EDGE, brute.exact(EDGE)) if e[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_no_python_on_the_main_path(edge):
    plan = exact_dedup.exact_dedup(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
