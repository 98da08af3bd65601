"""Streaming versions of the scoring and evaluation jobs.

Same Column functions as the batch jobs.  Every query keeps its progress
and state in a checkpoint folder under the shared checkpoint directory, so
a restarted driver or a lost executor resumes where it stopped; sinks are
either the file sink (exactly-once through its commit log) or a
``foreachBatch`` that overwrites idempotently per batch.  Groups of
completions on streams are in ``groups``.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType

from ..operators import evaluation as E
from ..operators import scoring as S
from ..session import scratch_path, set_conf, ship_package


def _checkpoint(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    return checkpoint or scratch_path(spark, f"stream-{name}")


def _start(writer, available_now: bool) -> StreamingQuery:
    _dropped(SparkSession.active())
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


_EPOCH_NTZ = "1970-01-01 00:00:00"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def ntz_to_instant(c) -> F.Column:
    """TIMESTAMP_NTZ wall-clock -> TIMESTAMP instant, reading the wall clock
    as UTC whatever the session time zone (a plain cast would use it)."""
    since_epoch = (c - F.lit(_EPOCH_NTZ).cast("timestamp_ntz")).cast("decimal(38,6)")
    return F.timestamp_micros((since_epoch * 1000000).cast("long"))


def instant_to_ntz(c) -> F.Column:
    """Inverse of ``ntz_to_instant``: UTC wall clock of an instant."""
    return F.lit(_EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(
        secs=(F.unix_micros(c).cast("decimal(38,6)") / 1000000))


def as_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``withWatermark`` needs TIMESTAMP (with zone); the tables carry
    TIMESTAMP_NTZ, read here as UTC wall clock."""
    if dict(df.dtypes).get(ts) == "timestamp_ntz":
        return df.withColumn(ts, ntz_to_instant(F.col(ts)))
    return df


def score_stream(stream: DataFrame, sink: str, gold: str = "answer", checkpoint: str | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Completions arriving as files -> scored rows (stateless, append)."""
    spark = stream.sparkSession
    scored = S.score_completions(stream, gold=gold)
    w = (scored.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", _checkpoint(spark, "score", checkpoint)).option("path", sink))
    return _start(w, available_now)


def accuracy_stream(stream: DataFrame, sink: str, tag: str = "tag", gold: str = "answer",
                    checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Running counters, accuracy and consistency per tag.

    The state is one row of long counters per tag (partial aggregation in
    each micro-batch).  Complete mode re-emits the small result table; each
    batch writes it to a folder of its own, so a batch that is run again
    overwrites only itself and readers (``latest_batch``) never meet a table
    that is being replaced.
    """
    spark = stream.sparkSession
    counters = E.eval_counters(S.score_completions(stream, gold=gold), tag)

    def write(batch: DataFrame, epoch: int) -> None:
        E.with_rates(batch).write.mode("overwrite").parquet(batch_folder(sink, epoch))

    w = (counters.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", _checkpoint(spark, "accuracy", checkpoint)))
    return _start(w, available_now)


def batch_folder(sink: str, epoch: int) -> str:
    return f"{sink}/batch={epoch:012d}"


def finished_batches(spark: SparkSession, sink: str) -> list[str]:
    """Folders of the batches that are written completely, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath().getParent().toString()) for f in found or [])


def latest_batch(spark: SparkSession, sink: str) -> DataFrame:
    """The result as of the last finished batch of a stream that writes ``batch_folder``s."""
    return spark.read.parquet(finished_batches(spark, sink)[-1])


def windowed_mean_updates(stream: DataFrame, sink: str, window: str = "6 hours", delay: str = "1 hour",
                          ts: str = "ts", value: str = "reward", by: tuple[str, ...] = (),
                          checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """As ``windowed_mean_stream``, but every batch writes the windows it
    has changed, open ones too; ``current_windows`` reads the last state of
    each, so no window is missing because its end hasn't been passed yet."""
    spark = stream.sparkSession
    agg = _windowed(stream, window, delay, ts, value, by)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(sink, epoch))

    w = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", _checkpoint(spark, "window-updates", checkpoint)))
    return _start(w, available_now)


def current_windows(spark: SparkSession, sink: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each window's last written state, of all finished batches."""
    rows = spark.read.option("basePath", sink).parquet(*finished_batches(spark, sink))
    keys = ["window_start", "window_end", *by]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("mean_value", "n"), "batch").alias("last"))
    return last.select(*keys, "last.mean_value", "last.n")


def _windowed(stream: DataFrame, window: str, delay: str, ts: str, value: str, by: tuple[str, ...]) -> DataFrame:
    agg = (as_event_time(stream, ts).withWatermark(ts, delay)
           .groupBy(F.window(ts, window).alias("w"), *by)
           .agg(F.avg(F.col(value).cast("double")).alias("mean_value"), F.count(F.lit(1)).alias("n")))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "mean_value", "n")


def windowed_mean_stream(stream: DataFrame, sink: str, window: str = "6 hours", delay: str = "1 hour",
                         ts: str = "ts", value: str = "value", by: tuple[str, ...] = ("name",),
                         checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Mean of a scalar (a reward or any recorded metric) per tumbling
    event-time window.  A window is written once, when the watermark
    (latest event time minus ``delay``) passes its end (append mode).
    Spark drops a row that is older than the previous micro-batch's
    watermark; a row between that and the current watermark may still be
    counted (``tests/test_streams.py`` pins this down)."""
    spark = stream.sparkSession
    w = (_windowed(stream, window, delay, ts, value, by).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", _checkpoint(spark, "window", checkpoint)).option("path", sink))
    return _start(w, available_now)


def dedup_score_stream(stream: DataFrame, sink: str, keys=("sample_id", "gen_idx"), ts: str = "ts",
                       delay: str = "1 day", gold: str = "answer", checkpoint: str | None = None,
                       available_now: bool = True, columns: list[str] | None = None) -> StreamingQuery:
    """A completion delivered twice (same key within the watermark
    delay) is scored once.

    ``arrivals`` marks the rows behind the watermark; the engine's own
    deduplication keeps the keys of the others in its state store (RocksDB)
    until the watermark is ``delay`` past their first row.  A batch reads its own
    rows and the state of their keys, so its cost doesn't grow with the batches before it.

    ``columns``: those of the stream and of SCORE that the sink gets besides the
    keys and ``ts``, by default all.  Scores are computed where rows are read,
    so a text that isn't among them never moves.

    The sink is one file sink (exactly once through its log), in two folders:
    ``late=0`` has the scored rows (``scored_rows``), ``late=1`` the late
    ones, without scores (``rejected_rows``).  So each row is in the sink, or a
    redelivery of a row there.  ``late_rows`` counts the rejects of all batches, and
    ``run_to_end`` raises if asked to allow none.  A row without a key column is
    a key of its own kind (nulls are equal); one without ``ts`` is never late."""
    spark, keys = stream.sparkSession, list(keys)
    scored = S.score_completions(stream, gold=gold)
    wanted = [c for c in scored.columns if c != ts and (columns is None or c in columns or c in keys)]
    marked = arrivals(scored.select(*wanted, ts), keys, ts, delay)
    # Late rows are told apart by their time too: only a late row that comes again as it was counts as redelivered.
    fresh = marked.withColumn(_LATE_AT, F.when(F.col(_LATE), F.col(_MICROS))).dropDuplicatesWithinWatermark([*keys, _LATE, _LATE_AT])
    out = fresh.select(*[F.when(~F.col(_LATE), F.col(c)).alias(c) if c in S.SCORED_COLUMNS else F.col(c) for c in wanted],
                       F.timestamp_micros(_MICROS).alias(ts), F.col(_LATE).cast("int").alias("late"))
    w = (out.writeStream.format("parquet").outputMode("append").partitionBy("late")
         .option("checkpointLocation", _checkpoint(spark, "dedup", checkpoint)).option("path", sink))
    with stateful(spark):
        q = _start(w, available_now)
    q.sink = sink
    return q


_LATE, _MICROS, _AT, _LATE_AT, _DEAL = "_late", "_micros", "_at", "_late_at", "_deal"
#: Stands for a missing event time; no timestamp of the engine's calendar.
_NO_TIME = -(1 << 63)


class _Arrivals(StatefulProcessor):
    """Passes rows on with ``_late``: whether they are behind the watermark.
    Keeps no state; the engine tells each group the watermark of its batch."""

    def __init__(self, columns: list[str]) -> None:
        self.columns, self.row = columns, Row(*columns, _LATE, _AT)

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        least = mark + 1  # what goes on must be younger than the watermark
        for r in rows:
            micros = r[_MICROS]
            late = mark > 0 and micros is not None and micros < mark
            at = _EPOCH + timedelta(microseconds=least if micros is None else max(micros, least))
            yield self.row(*[r[c] for c in self.columns], late, at)

    def close(self) -> None:
        pass


class _ArrivalFrames(_Arrivals):
    """``_Arrivals`` over frames of many rows: ``columns`` and ``time``, the microseconds or ``_NO_TIME``."""

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            micros, out = frame["time"], frame[self.columns].copy()
            out[_LATE] = (micros < mark) & (micros != _NO_TIME) & (mark > 0)
            out[_AT] = micros.clip(lower=mark + 1).astype("datetime64[us]").dt.tz_localize("UTC")
            yield out


#: Kinds of columns whose texts give them back exactly, are never empty and hold no comma.
AS_TEXT = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "decimal")
AS_IS = ("string", "binary")


def arrivals(stream: DataFrame, spread: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """``stream`` with ``ts`` as ``_micros``, ``_late`` (older than the latest
    event time of the batches before, less ``delay``), and ``_at``, the event
    time for what follows: late rows are carried on at the watermark instead
    of being dropped.  Rows are dealt by a hash of ``spread`` and ``ts``.

    Rows go through Python as frames, in which they are marked thousands at a
    time; their numbers travel as one text (a frame would make numbers with
    nulls floating-point ones).  Streams with columns of kinds that a text doesn't give back
    exactly (arrays, structs, timestamps and so on) go row by row."""
    spark = stream.sparkSession
    ship_package(spark)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    timed = as_event_time(stream, ts).withWatermark(ts, delay)
    kept = [c for c in stream.columns if c != ts]
    kinds = {c: stream.schema[c].dataType.simpleString() for c in kept}
    deal = F.pmod(F.xxhash64(*spread, ts), F.lit(parts)).cast("int").alias(_DEAL)
    # Without the event-time column itself: the engine would drop late rows before they are seen.
    if not all(k in AS_IS or k.split("(")[0] in AS_TEXT for k in kinds.values()):
        rows = timed.select(*kept, F.unix_micros(ts).alias(_MICROS), deal)
        schema = StructType([*[stream.schema[c] for c in kept], StructField(_MICROS, LongType()), StructField(_LATE, BooleanType()),
                             StructField(_AT, TimestampType())])
        return rows.groupBy(_DEAL).transformWithState(_Arrivals([*kept, _MICROS]), schema, "append", "EventTime", eventTimeColumnName=_AT)
    whole = {f"whole{i}": c for i, c in enumerate(c for c in kept if kinds[c] in AS_IS)}
    parted = [c for c in kept if kinds[c] not in AS_IS]
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in (*map(F.col, parted), F.unix_micros(ts))]
    rows = timed.select(*[F.col(c).alias(n) for n, c in whole.items()], F.concat_ws(",", *texts).alias("numbers"),
                        F.coalesce(F.unix_micros(ts), F.lit(_NO_TIME)).alias("time"), deal)
    schema = StructType([*[rows.schema[n] for n in (*whole, "numbers")], StructField(_LATE, BooleanType()), StructField(_AT, TimestampType())])
    marked = rows.groupBy(_DEAL).transformWithStateInPandas(_ArrivalFrames([*whole, "numbers"]), schema, "append", "EventTime",
                                                            eventTimeColumnName=_AT)
    marked = marked.withColumn("numbers", F.split("numbers", ","))

    def number(i: int, kind) -> Column:
        text = F.col("numbers")[i]
        return F.when(text != "", text).cast(kind)

    back = {c: F.col(n) for n, c in whole.items()} | {c: number(i, stream.schema[c].dataType) for i, c in enumerate(parted)}
    return marked.select(*[back[c].alias(c) for c in kept], number(len(parted), "long").alias(_MICROS), _LATE, _AT)


#: State on disk, with logs of changes instead of whole copies for each batch, no space taken in advance (a store
#: for each partition would take some megabytes), and one bound of memory for all stores of an executor.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256"}


@contextmanager
def stateful(spark: SparkSession):
    """Queries started inside keep their state as ``STATE`` says, whatever the session's setting (it is put back)."""
    with set_conf(spark, STATE):
        yield


def scored_rows(spark: SparkSession, sink: str) -> DataFrame:
    """What ``dedup_score_stream`` has scored."""
    return spark.read.parquet(sink).where("late = 0").drop("late")


def rejected_rows(spark: SparkSession, sink: str) -> DataFrame:
    """The late rows, unscored."""
    return spark.read.parquet(sink).where("late = 1").drop("late")


class _Dropped(StreamingQueryListener):
    """Adds up, over all batches of a run, the rows that Spark dropped behind the watermark."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()


_listeners: dict[str, _Dropped] = {}


def _dropped(spark: SparkSession) -> _Dropped:
    """The session's listener; one for each application."""
    app = spark.sparkContext.applicationId
    if app not in _listeners:
        _listeners[app] = _Dropped()
        spark.streams.addListener(_listeners[app])
    return _listeners[app]


def late_rows(q: StreamingQuery) -> int:
    """Rows that the query left out because they came after the watermark, in
    all its batches: the late rows in its sink if it keeps them, else those
    that Spark dropped in this run."""
    spark = SparkSession.active()
    if getattr(q, "sink", None):
        return rejected_rows(spark, q.sink).count()
    dropped, run = _dropped(spark), str(q.runId)
    if not q.isActive and not dropped.ended.setdefault(run, threading.Event()).wait(120):
        raise RuntimeError("the end of the query wasn't reported, so its late rows aren't known")
    return dropped.rows.get(run, 0)


def run_to_end(q: StreamingQuery, allow_late: bool = True) -> int:
    """Wait for an available-now query; raise its error if it failed.
    Returns the number of late rows, or raises if there are any and they
    aren't allowed."""
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    late = late_rows(q)
    if late and not allow_late:
        raise RuntimeError(f"{late} rows came after the watermark")
    return late
