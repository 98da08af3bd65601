"""Group rewards while completions arrive (R6 and R7 on streams).

A group's rows wait in the engine's state store, under the group's bucket (a
hash of its key), until ``g`` generations are there; then the group's advantages are written, once.  A
timer ``delay`` past the group's first row ends it: a group that is still
incomplete gets the advantages of what has come, every group gets its audit
row, and its state goes.  So the state holds the groups of one ``delay``, each
with at most ``MOST`` generations.  The engine calls Python once for a bucket,
not for each group, with one read and one write of its state; a bucket has one timer at a time, for the first of its groups to end.

The sink is one file sink, with a folder for each kind of row: ``advantage``,
``audit`` and ``late`` (``advantages``, ``audits``, ``late_completions``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions import fixed
from ..session import ship_package
from .streams import _checkpoint, _start, as_event_time, stateful

#: Generations of a group that are remembered; redeliveries beyond count as extra rows.
MOST = 1024
#: Buckets of groups; fixed when a stream first starts.  A batch reads and writes the buckets of its groups.
BUCKETS = 1 << 14
BUCKET = ("timer long, keys array<{kind}>, ends array<bigint>, gens array<array<int>>, rewards array<array<double>>, "
          "n_rows array<bigint>, done array<boolean>")
OUT = ("gen_idx int, reward double, group_mean double, group_std double, advantage double, "
       "n_rows long, n_gens long, min_reward double, max_reward double, status string, kind string")
ADVANTAGE = ("gen_idx", "reward", "group_mean", "group_std", "advantage")
AUDIT = ("n_rows", "n_gens", "min_reward", "max_reward", "status")
_BUCKET = "_bucket"
_NAMES = [f.split()[0] for f in OUT.split(", ")]


def statistics(rewards: list[float | None]) -> tuple[float | None, float | None]:
    """Mean and sample deviation of the rewards that are there, as ``operators.groups.group_stats`` has them."""
    known = [r for r in rewards if r is not None]
    if not known:
        return None, None
    mean = math.fsum(known) / len(known)
    return mean, math.sqrt(math.fsum((r - mean) ** 2 for r in known) / (len(known) - 1)) if len(known) > 1 else None


def advantage(reward: float | None, n: int, mean: float | None, std: float | None, scale: bool, eps: float) -> float | None:
    if reward is None:
        return None
    if scale:
        return (reward - mean) / (std + eps) if std else 0.0
    return reward - mean if n > 1 else 0.0


def status(n_rows: int, n_gens: int, least: float | None, most: float | None, g: int) -> str:
    if n_rows > n_gens:
        return "duplicate"
    if n_gens != g:
        return "missing" if n_gens < g else "extra"
    return "flat" if least is not None and least == most else "ok"


#: Kinds of keys that are equal in Python if and only if the engine groups them; a group of another kind has a bucket of its own.
PLAIN = ("tinyint", "smallint", "int", "bigint", "boolean", "string", "float", "double")
_NAN = float("nan")


def name(key):
    """What tells a group of a ``PLAIN`` kind from others of its bucket."""
    return _NAN if key != key else key


class _Groups(StatefulProcessor):
    """Holds groups until they are complete or their time is over, those of a
    bucket in one value: a call of the engine, its state and its timer serve them together."""

    def __init__(self, key: str, kind: str, g: int, delay_ms: int, scale: bool, eps: float) -> None:
        self.key, self.g, self.delay_ms, self.scale, self.eps = key, g, delay_ms, scale, eps
        self.plain, self.kind = kind in PLAIN, kind if kind in PLAIN else "int"
        self.row = Row(key, *_NAMES)

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", BUCKET.format(kind=self.kind))

    def _out(self, key, kind: str, **values) -> Row:
        return self.row(key, *[kind if n == "kind" else values.get(n) for n in _NAMES])

    def _advantages(self, key, gens: list[int], rewards: list[float | None]):
        mean, std = statistics(rewards)
        n = sum(r is not None for r in rewards)
        for gen, r in zip(gens, rewards):
            yield self._out(key, "advantage", gen_idx=gen, reward=r, group_mean=mean, group_std=std,
                            advantage=advantage(r, n, mean, std, self.scale, self.eps))

    def _held(self) -> tuple[int | None, dict]:
        """The time of the bucket's timer, and its groups: name -> [key, end, gens, rewards, n_rows, done]."""
        held = self.bucket.get()  # None: a new bucket
        if not held:
            return None, {}
        return held[0], {name(group[0]): [*group[:2], list(group[2]), list(group[3]), *group[4:]] for group in zip(*held[1:])}

    def _hold(self, timer: int, groups: dict) -> None:
        self.bucket.update((timer, *map(list, zip(*groups.values()))))

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        timer, groups = self._held()
        firsts, seen = {}, {}
        for r in rows:
            key = r[self.key]
            if mark > 0 and r.ms is not None and r.ms < mark:
                yield self._out(key, "late", gen_idx=r.gen_idx, reward=r.reward)
                continue
            held, at = key if self.plain else 0, mark if r.ms is None else r.ms
            named = name(held)
            group = groups.get(named)
            if group is None:
                group = groups[named] = [held, None, [], [], 0, False]
            if group[1] is None:  # in its first batch: the end is known when all rows are
                firsts[named] = min(firsts.get(named, at), at)
            gens, rewards = group[2], group[3]
            group[4] += 1
            known = seen.get(named)
            if known is None:
                known = seen[named] = set(gens)
            if r.gen_idx in known or len(gens) >= MOST:
                continue
            known.add(r.gen_idx)
            gens.append(r.gen_idx)
            rewards.append(r.reward)
            if group[5]:  # the group's advantages are written already
                yield self._out(key, "advantage", gen_idx=r.gen_idx, reward=r.reward)
            elif len(gens) == self.g:
                group[5] = True
                yield from self._advantages(key, gens, rewards)
        if not seen:
            return
        for named, first in firsts.items():
            groups[named][1] = max(first, mark) + self.delay_ms
        least = min(group[1] for group in groups.values())
        if timer is None or least < timer:
            timer = least
            self.handle.registerTimer(timer)
        self._hold(timer, groups)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        over = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        timer, groups = self._held()
        for named in [n for n, group in groups.items() if group[1] <= over]:
            held, _, gens, rewards, n_rows, done = groups.pop(named)
            of = held if self.plain else key[0]
            if not done:
                yield from self._advantages(of, gens, rewards)
            known = [r for r in rewards if r is not None]
            least, most = min(known, default=None), max(known, default=None)
            n_gens = sum(x is not None for x in gens)
            yield self._out(of, "audit", n_rows=n_rows, n_gens=n_gens, min_reward=least, max_reward=most,
                            status=status(n_rows, n_gens, least, most, self.g))
        if not groups:
            self.bucket.clear()
        elif timer <= over:  # a later timer is registered already
            timer = min(group[1] for group in groups.values())
            self.handle.registerTimer(timer)
            self._hold(timer, groups)
        else:
            self._hold(timer, groups)

    def close(self) -> None:
        pass


def advantage_stream(stream: DataFrame, sink: str, key: str = "sample_id", gen: str = "gen_idx", reward: str = "reward",
                     ts: str = "ts", g: int = fixed.GROUP_SIZE, delay_ms: int = 3_600_000, scale_rewards: bool = True,
                     eps: float = 1e-4, checkpoint: str | None = None, available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """R6 and R7 over scored rows as they arrive, in any order.

    Rows older than the watermark (latest event time of the batches before,
    less ``delay_ms``) are late and only written as such.  A generation that
    is delivered again counts in the audit but gets no second advantage; one beyond the ``g`` of a complete group
    gets a NULL advantage, and its group is ``extra``.  Rows without a reward
    have a NULL advantage, rows without a key too (they belong to no group
    and have no audit row); a row without ``ts`` is never late.  Of groups whose
    time isn't over when the stream ends, the audit and the advantages of
    incomplete ones come with a later run.

    Redeliveries of one key meet in one task, as its state does; each costs a
    set lookup there, and nothing is kept of it.  ``buckets`` may not change between runs on one ``checkpoint``.
    """
    spark = stream.sparkSession
    ship_package(spark)
    timed = as_event_time(stream, ts).withWatermark(ts, f"{delay_ms} milliseconds")
    kind = stream.schema[key].dataType.simpleString()
    # Zeros of either sign are one key, as in grouping.
    keyed = (F.col(key) + F.lit(0).cast(kind)).alias(key) if kind in ("float", "double") else F.col(key)
    rows = timed.select(keyed, F.col(gen).cast("int").alias("gen_idx"), F.col(reward).cast("double").alias("reward"),
                        F.unix_millis(ts).alias("ms"))
    processor = _Groups(key, kind, g, delay_ms, scale_rewards, eps)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)) if kind in PLAIN else F.col(key)
    bucketed = rows.where(F.col(key).isNotNull()).withColumn(_BUCKET, bucket)
    grouped = bucketed.groupBy(_BUCKET).transformWithState(
        processor, f"{key} {kind}, {OUT}", "append", "EventTime")
    loose = rows.where(F.col(key).isNull()).select(
        key, *[(F.lit("advantage") if n == "kind" else F.col(n) if n in ("gen_idx", "reward") else F.lit(None)).cast(t).alias(n)
               for n, t in (f.split() for f in OUT.split(", "))])
    w = (grouped.unionByName(loose).writeStream.format("parquet").outputMode("append").partitionBy("kind")
         .option("checkpointLocation", _checkpoint(spark, "advantage", checkpoint)).option("path", sink))
    with stateful(spark):
        return _start(w, available_now)


def _of(spark: SparkSession, sink: str, kind: str, columns: tuple[str, ...]) -> DataFrame:
    rows = spark.read.parquet(sink).where(F.col("kind") == kind)
    return rows.select(rows.columns[0], *columns)


def advantages(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of R6: key, gen_idx, reward, group_mean, group_std, advantage."""
    return _of(spark, sink, "advantage", ADVANTAGE)


def audits(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of R7: key, n_rows, n_gens, min_reward, max_reward, status."""
    return _of(spark, sink, "audit", AUDIT)


def late_completions(spark: SparkSession, sink: str) -> DataFrame:
    """Rows that came behind the watermark: key, gen_idx, reward."""
    return _of(spark, sink, "late", ("gen_idx", "reward"))
