"""Group rewards on streams against the batch operators, and the state of streams with many micro-batches."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from rubric.operators import groups as G
from rubric.session import scratch_path
from rubric.streaming import groups as XG
from rubric.streaming import streams as X

SCHEMA = "sample_id long, gen_idx int, reward double, ts timestamp_ntz"
START = datetime.datetime(2024, 1, 1)
HOUR = 3_600_000


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def deliver(spark, src, batches):
    """One file for each batch, in order of their modification times."""
    for i, rows in enumerate(batches):
        part = scratch_path(spark, "part")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part.removeprefix("file:")) if f.endswith(".parquet"))
        os.makedirs(src.removeprefix("file:"), exist_ok=True)
        target = os.path.join(src.removeprefix("file:"), f"{i:05d}.parquet")
        os.rename(os.path.join(part.removeprefix("file:"), name), target)
        os.utime(target, (1_700_000_000 + 10 * i,) * 2)


def source(spark, src):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


BATCHES = [
    [(1, 2, 0.5, at(0)), (2, 0, 1.0, at(1)), (3, 0, None, at(2)), (5, 0, 2.0, at(3))],
    [(1, 0, 1.5, at(1)), (2, 0, 1.0, at(1)), (3, 1, 0.25, at(0)), (None, 0, 7.0, at(2)), (4, 0, 1.0, at(4)), (4, 1, 1.0, at(4))],
    [(1, 1, 1.0, at(5)), (4, 2, 1.0, at(2)), (3, 2, 0.75, None), (5, 1, 1.0, at(5)), (5, 2, 0.0, at(5))],
    [(5, 3, 9.0, at(6)), (6, 0, 0.0, at(200))],
    [(7, 0, 3.0, at(7)), (6, 1, 1.0, at(201))],
    [(8, 0, 1.0, at(2000)), (8, 1, 1.0, at(2000))],
    [(9, 0, 1.0, at(4000))],
]


def test_equals_the_batch_operators(spark):
    src, sink = scratch_path(spark, "gs-src"), scratch_path(spark, "gs-sink")
    deliver(spark, src, BATCHES)
    q = XG.advantage_stream(source(spark, src), sink, g=3, delay_ms=HOUR)
    X.run_to_end(q)
    assert [tuple(r) for r in XG.late_completions(spark, sink).collect()] == [(7, 0, 3.0)]
    # Batch: rows that aren't late, each generation once; 9's time isn't over.
    rows = [r for b in BATCHES for r in b if r[0] not in (7, 9)]
    audit = {r.sample_id: tuple(r)[1:] for r in G.group_audit(spark.createDataFrame([r for r in rows if r[0]], SCHEMA), g=3).collect()}
    assert {r.sample_id: tuple(r)[1:] for r in XG.audits(spark, sink).collect()} == audit
    assert {k: v[-1] for k, v in audit.items()} == {1: "ok", 2: "duplicate", 3: "ok", 4: "flat", 5: "extra", 6: "missing", 8: "missing"}
    once = {(r[0], r[1]): r for r in rows if r[:2] != (5, 3)}.values()
    want = {(r.sample_id, r.gen_idx): r.advantage for r in G.group_advantage(spark.createDataFrame(list(once), SCHEMA)).collect()}
    got = {(r.sample_id, r.gen_idx): r.advantage for r in XG.advantages(spark, sink).collect()}
    assert got.pop((5, 3)) is None  # beyond a complete group
    assert got == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert want[(3, 0)] is None and want[(None, 0)] is None


def test_groups_that_share_a_bucket(spark):
    """All groups in two buckets, some of which end before others: same rows as one by one, few timers."""
    out = []
    for buckets in (2, XG.BUCKETS):
        src, sink, check = (scratch_path(spark, f"gb-{x}") for x in ("src", "sink", "checkpoint"))
        deliver(spark, src, BATCHES + [[(9, 1, 1.0, at(4001)), (10, 0, 1.0, at(8000))]])
        q = XG.advantage_stream(source(spark, src), sink, g=3, delay_ms=HOUR, checkpoint=check, buckets=buckets)
        X.run_to_end(q)
        out.append([sorted(map(repr, f(spark, sink).collect())) for f in (XG.advantages, XG.audits, XG.late_completions)])
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6  # the group of 10
    assert out[0] == out[1] and len(out[0][1]) == 8


def test_keys_of_other_types(spark):
    """Zeros of either sign, NaN, decimals and bytes, all in one bucket or each in its own."""
    nan = float("nan")
    rows = [(0.0, 0, 1.0, at(0)), (-0.0, 1, 2.0, at(0)), (nan, 0, 3.0, at(0)), (nan, 1, 4.0, at(0)), (1.5, 0, 0.0, at(0))]
    for cast in ("double", "decimal(5,2)", "binary"):
        src, sink = scratch_path(spark, "gk-src"), scratch_path(spark, "gk-sink")
        d = spark.createDataFrame(rows, "k double, gen_idx int, reward double, ts timestamp_ntz")
        key = (F.encode(F.abs("k").cast("string"), "utf-8") if cast == "binary"
               else F.when(~F.isnan("k"), F.col("k")).cast(cast) if cast.startswith("decimal") else F.col("k"))
        d = d.withColumn("k", key)
        d.write.parquet(src)
        last = spark.createDataFrame([(9, 0, 0.0, at(500))], "n int, gen_idx int, reward double, ts timestamp_ntz")
        last.select(F.lit(None).cast(d.schema["k"].dataType).alias("k"), "gen_idx", "reward", "ts").write.mode("append").parquet(src)
        stream = spark.readStream.schema(d.schema).parquet(src)
        X.run_to_end(XG.advantage_stream(stream, sink, key="k", g=2, delay_ms=HOUR, buckets=1))
        audits = sorted((r.n_rows, r.n_gens, r.status) for r in XG.audits(spark, sink).collect())
        whole = [(2, 2, "ok")] * (1 if cast.startswith("decimal") else 2)
        assert audits == [(1, 1, "missing"), *whole], cast


def test_a_restart_goes_on_where_it_stopped(spark):
    src, sink, check = (scratch_path(spark, f"gr-{x}") for x in ("src", "sink", "checkpoint"))
    deliver(spark, src, BATCHES[:3])
    X.run_to_end(XG.advantage_stream(source(spark, src), sink, g=3, delay_ms=HOUR, checkpoint=check))
    first = {(r.sample_id, r.gen_idx) for r in XG.advantages(spark, sink).collect()}
    assert (1, 0) in first and (2, 0) not in first
    more = scratch_path(spark, "gr-more")
    deliver(spark, more, BATCHES[3:])
    for i, f in enumerate(sorted(os.listdir(more.removeprefix("file:")))):
        target = os.path.join(src.removeprefix("file:"), f"1{f}")
        os.rename(os.path.join(more.removeprefix("file:"), f), target)
        os.utime(target, (1_700_001_000 + 10 * i,) * 2)
    X.run_to_end(XG.advantage_stream(source(spark, src), sink, g=3, delay_ms=HOUR, checkpoint=check))
    rows = [(r.sample_id, r.gen_idx) for r in XG.advantages(spark, sink).collect()]
    assert len(rows) == len(set(rows)) and first < set(rows)
    assert len(XG.audits(spark, sink).collect()) == 7


def test_many_batches_cost_the_same(spark):
    """X4 over many micro-batches whose watermark moves on: a batch's time doesn't grow (``RUBRIC_BATCHES=200`` takes some minutes)."""
    n = int(os.environ.get("RUBRIC_BATCHES", 40))
    schema = "sample_id long, gen_idx int, completion string, answer string, ts timestamp_ntz"
    src, sink = scratch_path(spark, "many-src"), scratch_path(spark, "many-sink")
    rows = [(i // 2, 0, "<answer>yes</answer>", "yes", at(60 * (i // 2))) for i in range(2 * n)]  # each twice
    frame = spark.createDataFrame(rows, schema)
    frame.repartitionByRange(n, "sample_id").write.parquet(src)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 500)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = X.dedup_score_stream(stream, sink, delay="400 days")
        assert X.run_to_end(q) == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    done = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(done) == n
    took = [p["batchDuration"] for p in done]
    early, late = (sorted(some)[len(some) // 2] for some in (took[n // 10:n // 3], took[-n // 4:]))
    assert late < 2 * early, (early, late)
    assert X.scored_rows(spark, sink).count() == n == X.scored_rows(spark, sink).select("sample_id").distinct().count()


def test_state_ends_with_the_watermark(spark):
    schema = "sample_id long, gen_idx int, completion string, answer string, ts timestamp_ntz"
    src, sink = scratch_path(spark, "ends-src"), scratch_path(spark, "ends-sink")
    rows = [(i, 0, "<answer>yes</answer>", "yes", at(60 * i)) for i in range(30)]
    spark.createDataFrame(rows, schema).repartitionByRange(15, "sample_id").write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src).withColumn("ts", F.col("ts"))
    q = X.dedup_score_stream(stream, sink, delay="2 hours")
    X.run_to_end(q)
    state = [op["numRowsTotal"] for op in q.lastProgress["stateOperators"]]
    assert max(state) <= 5  # keys younger than two delays, not all 30
    assert X.scored_rows(spark, sink).count() == 30
