"""S5 on streams: each row once over restarts and re-runs, and a bounded number of files."""

import os

import pytest
from pyspark.sql import functions as F

from rubric.session import scratch_path
from rubric.streaming import appends as A
from rubric.streaming import streams as X

SCHEMA = "step long, name string, value double"


def files(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path.removeprefix("file:")) for f in names)


def source(spark, n, start=0, src=None):
    src = src or scratch_path(spark, "append-src")
    spark.range(start, start + 3 * n).select(F.col("id").alias("step"), F.lit("loss").alias("name"), (F.col("id") / 7).alias("value")) \
        .repartitionByRange(n, "step").write.mode("append").parquet(src)
    return src


def stream(spark, src):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def test_restarts_and_merges(spark):
    src, path, check = source(spark, 5), scratch_path(spark, "append-sink"), scratch_path(spark, "append-check")
    X.run_to_end(A.append_stream(stream(spark, src), path, every=3, checkpoint=check))
    assert sorted(r.step for r in A.appended(spark, path).collect()) == list(range(15))
    source(spark, 8, start=15, src=src)
    X.run_to_end(A.append_stream(stream(spark, src), path, every=3, checkpoint=check))
    assert sorted(r.step for r in A.appended(spark, path).collect()) == list(range(39))
    assert A.covering(A.finished_parts(spark, path)) == [(0, 8), (9, 11), (12, 12)]
    assert files(path) <= 9  # 13 batches


def test_a_batch_that_is_run_again_overwrites_itself(spark):
    """The second stream starts over with the same rows (a lost commit log): same parts, no row twice."""
    src, path = source(spark, 4), scratch_path(spark, "append-again")
    for _ in range(2):
        X.run_to_end(A.append_stream(stream(spark, src), path, every=3))
        assert sorted(r.step for r in A.appended(spark, path).collect()) == list(range(12))


def test_unfinished_parts_are_not_read(spark):
    src, path = source(spark, 4), scratch_path(spark, "append-unfinished")
    X.run_to_end(A.append_stream(stream(spark, src), path, every=2))
    whole = A.part_folder(path, 0, 3).removeprefix("file:")
    os.remove(os.path.join(whole, "_SUCCESS"))
    assert (0, 3) not in A.finished_parts(spark, path)
    rest = A.covering(A.finished_parts(spark, path))
    assert rest[-1] == (2, 3)


@pytest.mark.parametrize("n", [1, 9, 10, 99, 1000, 12345])
def test_parts_stay_few(n):
    parts = set()
    for epoch in range(n):
        parts = {p for p in parts if p in set(A.covering(sorted(parts)))} | {(epoch, epoch)}
        size = 10
        while (epoch + 1) % size == 0:
            parts.add((epoch + 1 - size, epoch))
            size *= 10
    left = A.covering(sorted(parts))
    assert [x for first, last in left for x in (first, last)][0] == 0 and left[-1][1] == n - 1
    assert all(a[1] + 1 == b[0] for a, b in zip(left, left[1:])) and len(left) <= 9 * len(str(n))
