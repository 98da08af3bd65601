"""Training-run tables: epoch losses, evaluation schedule, best checkpoints
and reward curves (A5, A6, W4-W6).

Every job first aggregates the metrics table to one row per (run, epoch)
(partial + final aggregate, skew-safe), and only then applies windows, so a
window partition holds one run's epochs - never the raw event rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def epoch_loss(metrics: DataFrame, name: str = fixed.METRIC_BATCH_LOSS) -> DataFrame:
    """A5: mean recorded batch loss per (run, epoch)."""
    return (metrics.where(F.col("name") == F.lit(name))
            .groupBy("run_id", "epoch").agg(F.avg("value").alias("loss"), F.count(F.lit(1)).alias("n_steps")))


def pass_rates(metrics: DataFrame, name: str = fixed.METRIC_PASS_RATE) -> DataFrame:
    """Pass rate per (run, epoch) as the run recorded it: the record of the
    last step (the greatest value, should a step have several)."""
    last = F.max(F.struct("step", "value"))
    return (metrics.where(F.col("name") == F.lit(name))
            .groupBy("run_id", "epoch").agg(last.alias("last")).select("run_id", "epoch", F.col("last.value").alias("pass_rate")))


def pass_rates_from_outcomes(metrics: DataFrame, name: str = fixed.METRIC_SAMPLE_OK) -> DataFrame:
    """Pass rate per (run, epoch) of runs that recorded a 0/1 outcome per test sample: their mean."""
    return (metrics.where(F.col("name") == F.lit(name))
            .groupBy("run_id", "epoch").agg(F.avg("value").alias("pass_rate")))


def eval_schedule(per_epoch: DataFrame, eval_freq: int) -> DataFrame:
    """Flag epochs with ``epoch % eval_freq == 0`` or the run's last epoch."""
    last = F.max("epoch").over(Window.partitionBy("run_id"))
    return per_epoch.select("*", ((F.col("epoch") % eval_freq == 0) | (F.col("epoch") == last))
                            .alias("should_eval"))


def best_checkpoints(rates: DataFrame, eval_freq: int, save_freq: int) -> DataFrame:
    """Among evaluated epochs with ``epoch % save_freq == 0``, those whose
    pass rate is strictly above every earlier saved one (a tie is not kept)."""
    evaluated = eval_schedule(rates, eval_freq).where(F.col("should_eval") & (F.col("epoch") % save_freq == 0))
    prev = F.max("pass_rate").over(Window.partitionBy("run_id").orderBy("epoch")
                                   .rowsBetween(Window.unboundedPreceding, -1))
    return (evaluated.select("*", prev.alias("_prev"))
            .where(F.col("_prev").isNull() | (F.col("pass_rate") > F.col("_prev")))
            .drop("_prev", "should_eval"))


def fmt2(c: Column) -> Column:
    """``%.2f`` with the exact binary value rounded half-even (as Python
    does); ``format_string`` would round 0.125 up."""
    return F.regexp_replace(F.format_number(c, 2), ",", "")


def checkpoint_name(epoch: Column, loss: Column, pass_rate: Column) -> Column:
    """``fixed.CHECKPOINT_NAME`` filled in."""
    head, rest = fixed.CHECKPOINT_NAME.split("{epoch}")
    middle, rest = rest.split("{loss:.2f}")
    before, tail = rest.split("{pass_rate:.2f}")
    return F.concat(F.lit(head), epoch.cast("string"), F.lit(middle), fmt2(loss), F.lit(before), fmt2(pass_rate), F.lit(tail))


def require_metrics(metrics: DataFrame, *names: str) -> None:
    """Raise if the table has no record of one of ``names``: a job on it would quietly return nothing."""
    for name in names:
        if metrics.where(F.col("name") == F.lit(name)).limit(1).count() == 0:
            raise ValueError(f"no record of {name!r} in the metrics table")


def best_checkpoint_names(metrics: DataFrame, eval_freq: int, save_freq: int, rates: DataFrame | None = None) -> DataFrame:
    """W5 + W6: names of the checkpoints that would be written, by the
    recorded pass rates or the given ``rates`` (run_id, epoch, pass_rate)."""
    best = best_checkpoints(pass_rates(metrics) if rates is None else rates, eval_freq, save_freq)
    return (best.join(epoch_loss(metrics), ["run_id", "epoch"], "left")
            .select("run_id", "epoch", "pass_rate", "loss",
                    checkpoint_name(F.col("epoch"), F.col("loss"), F.col("pass_rate")).alias("checkpoint")))


def reward_curve(df: DataFrame, step: Column | str, n: int = 10, reward: str = "reward") -> DataFrame:
    """Mean reward per block of ``n`` steps."""
    s = F.col(step) if isinstance(step, str) else step
    return (df.groupBy(F.floor(s / F.lit(n)).cast("bigint").alias("block"))
            .agg(F.avg(F.col(reward).cast("double")).alias("mean_reward"), F.count(F.lit(1)).alias("n")))
