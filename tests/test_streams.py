"""Streams across micro-batches: late rows past the watermark are dropped
(X3) and a key delivered again in a later batch is scored once (X4)."""

import time

import pytest
from pyspark.sql import functions as F

from rubric.session import scratch_path
from rubric.streaming import streams as X

SCHEMA = "name string, value double, ts timestamp_ntz"


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)   # distinct modification times keep the file order


def _ts(s):
    import datetime
    return datetime.datetime.fromisoformat(s)


def test_late_rows_are_dropped(spark):
    """One file per micro-batch.  Spark filters late rows with the previous
    batch's watermark and evicts windows with the current one, so the late
    row comes two batches after the row that moved the watermark."""
    src, sink = scratch_path(spark, "late-src"), scratch_path(spark, "late-sink")
    _write(spark, [("m", 1.0, _ts("2024-01-01 01:00:00")), ("m", 3.0, _ts("2024-01-01 13:00:00"))], SCHEMA, src)
    _write(spark, [("m", 7.0, _ts("2024-01-01 13:30:00"))], SCHEMA, src)        # on time
    # belongs to the first window, far behind the watermark (13:00 - 1h): dropped
    _write(spark, [("m", 100.0, _ts("2024-01-01 02:00:00"))], SCHEMA, src)
    # a closing row so the 12:00-18:00 window is final too
    _write(spark, [("m", 5.0, _ts("2024-01-02 00:00:00"))], SCHEMA, src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = X.windowed_mean_stream(stream, sink)
    X.run_to_end(q)
    out = {(r.window_start.hour, r.n): r.mean_value
           for r in spark.read.parquet(sink).select(X.instant_to_ntz(F.col("window_start")).alias("window_start"),
                                                    "n", "mean_value").collect()}
    assert out == {(0, 1): 1.0, (12, 2): 5.0}
    assert X.late_rows(q) == 1


def test_late_rows_can_be_refused(spark):
    src, sink = scratch_path(spark, "refuse-src"), scratch_path(spark, "refuse-sink")
    for ts in ("2024-01-01 13:00:00", "2024-01-01 13:30:00", "2024-01-01 02:00:00", "2024-01-02 00:00:00"):
        _write(spark, [("m", 1.0, _ts(ts))], SCHEMA, src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    with pytest.raises(RuntimeError, match="1 rows came after"):
        X.run_to_end(X.windowed_mean_updates(stream, sink, value="value", by=("name",)), allow_late=False)
    out = X.current_windows(spark, sink, by=("name",)).collect()
    # the open window of the last row is there too, and the one that got two rows has its last state
    assert sorted((r.window_start.hour, r.n) for r in out) == [(0, 1), (12, 2)]
    assert len(X.finished_batches(spark, sink)) >= 4


def test_redelivery_in_a_later_batch_is_scored_once(spark):
    schema = "sample_id long, gen_idx int, completion string, answer string, ts timestamp_ntz"
    src, sink = scratch_path(spark, "dup-src"), scratch_path(spark, "dup-sink")
    row = (1, 0, "<think>so yes</think><answer>yes</answer>", "yes", _ts("2024-01-01 00:00:00"))
    _write(spark, [row, (2, 0, "<answer>no</answer>", "no", _ts("2024-01-01 00:00:01"))], schema, src)
    _write(spark, [row], schema, src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    X.run_to_end(X.dedup_score_stream(stream, sink))
    rows = X.scored_rows(spark, sink).select("sample_id", "is_correct", "is_consist").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, 1), (2, 1, 0)]


def test_late_completions_are_kept_and_counted(spark):
    """More batches than the progress updates that a session keeps."""
    schema = "sample_id long, gen_idx int, completion string, answer string, ts timestamp_ntz"
    src, sink = scratch_path(spark, "reject-src"), scratch_path(spark, "reject-sink")
    for i, ts in [(1, "2024-01-05 00:00:00"), (1, "2024-01-05 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-05 01:00:00"),
                                 (4, "2024-01-05 02:00:00"), (5, "2024-01-05 03:00:00")]:
        _write(spark, [(i, 0, "<answer>yes</answer>", "yes", _ts(ts))], schema, src)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        q = X.dedup_score_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), sink)
        assert X.run_to_end(q) == 1 and len(q.recentProgress) <= 2
        windows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("value", F.lit(1.0))
        w = X.windowed_mean_updates(windows, scratch_path(spark, "reject-windows"), value="value")
        with pytest.raises(RuntimeError, match="1 rows came after"):
            X.run_to_end(w, allow_late=False)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert [(r.sample_id, r.answer) for r in X.rejected_rows(spark, sink).collect()] == [(2, "yes")]
    assert sorted(r.sample_id for r in X.scored_rows(spark, sink).collect()) == [1, 3, 4, 5]
