"""Group operators over G completions per prompt.

Skew: a prompt normally has G rows, but a broken producer can deliver one
key many times.  Group statistics are therefore computed with a grouped
aggregate (partial aggregation in every map task, so a hot key collapses to
one row per task before the shuffle) and attached back with a salted join
(``skew.salted_join``) that splits any hot key over many tasks.  A window
over the key would instead put a hot group into a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.tables import fan_out  # noqa: F401  (R5 lives with the derivations)
from .skew import salted_join


def group_stats(df: DataFrame, key: str = "sample_id", reward: str = "reward") -> DataFrame:
    r = F.col(reward).cast("double")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("group_rows"), F.count(r).alias("group_n"),
                               F.avg(r).alias("group_mean"), F.stddev_samp(r).alias("group_std"))


def group_advantage(df: DataFrame, key: str = "sample_id", reward: str = "reward",
                    scale_rewards: bool = True, eps: float = 1e-4) -> DataFrame:
    """Reward minus its group mean, divided by (group std + eps) when
    ``scale_rewards`` (sample std, as the group-relative trainer does; the
    small ``eps`` guards a near-zero spread).  A group of one row or with
    zero spread gets advantage 0.0.  A row without a reward or without a key
    keeps a NULL advantage: rows out = rows in.

    ``df`` is a written table (its rows are salted by their position).
    """
    stats = group_stats(df, key, reward)
    j = salted_join(df, stats, key, counts=stats, n="group_rows", how="left")
    centred = F.col(reward).cast("double") - F.col("group_mean")
    if scale_rewards:
        adv = (F.when(F.col("group_std").isNull() | (F.col("group_std") == 0), F.lit(0.0))
               .otherwise(centred / (F.col("group_std") + F.lit(eps))))
    else:
        adv = F.when(F.col("group_n") <= 1, F.lit(0.0)).otherwise(centred)
    known = F.col(key).isNotNull() & F.col(reward).isNotNull()
    return j.select(*df.columns, "group_mean", "group_std", F.when(known, adv).alias("advantage"))


def missing_prompts(prompts: DataFrame, completions: DataFrame, key: str = "sample_id") -> DataFrame:
    """Prompts with no completion at all, which ``group_audit`` cannot see."""
    return prompts.join(completions.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).select(key), key, "left_anti")


def group_audit(df: DataFrame, key: str = "sample_id", gen: str = "gen_idx", reward: str = "reward",
                g: int = fixed.GROUP_SIZE) -> DataFrame:
    """One row per group with its size, distinct generations, reward
    spread and a status: duplicate, missing, extra, flat (no learning
    signal) or ok.  Filter ``status != 'ok'`` for the problem groups."""
    a = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"),
                            F.countDistinct(gen).alias("n_gens"),
                            F.min(F.col(reward).cast("double")).alias("min_reward"),
                            F.max(F.col(reward).cast("double")).alias("max_reward"))
    status = (F.when(F.col("n_rows") > F.col("n_gens"), F.lit("duplicate"))
              .when(F.col("n_gens") < F.lit(g), F.lit("missing"))
              .when(F.col("n_gens") > F.lit(g), F.lit("extra"))
              .when(F.col("min_reward") == F.col("max_reward"), F.lit("flat"))
              .otherwise(F.lit("ok")))
    return a.select("*", status.alias("status"))
