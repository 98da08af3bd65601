"""Key joins.

No broadcast hint is given for the data sides: both grow with the data.
AQE turns a join into a broadcast at runtime when one side's measured
shuffle output is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``
and keeps the sort-merge join beyond it.  Keys of the big side that hold a
large share of its rows (one sample delivered many times, one image shared
by most samples) are salted (``skew.salted_join``); ``skew_safe=False``
gives the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import key_counts, salted_join


def _join(big: DataFrame, small: DataFrame, key: str, how: str, skew_safe: bool) -> DataFrame:
    if not skew_safe:
        return big.join(small, key, how)
    return salted_join(big, small, key, counts=key_counts(big.select(key), key), how=how)


def attach_gold(completions: DataFrame, gold: DataFrame, key: str = "sample_id",
                skew_safe: bool = True) -> DataFrame:
    """Pair completions with gold answers by key (not by position).
    ``gold`` has one row per key (see ``unique_gold``); completions without
    a key match nothing."""
    return _join(completions, gold, key, "inner", skew_safe)


def unmatched_completions(completions: DataFrame, gold: DataFrame, key: str = "sample_id",
                          skew_safe: bool = True) -> DataFrame:
    """Completions that have no gold row (reported, never scored), those
    without a key included."""
    return _join(completions, gold.select(key), key, "left_anti", skew_safe)


def unmatched_gold(gold: DataFrame, completions: DataFrame, key: str = "sample_id") -> DataFrame:
    """Gold rows that no completion matches, those without a key included."""
    return gold.join(key_counts(completions, key).select(key), key, "left_anti")


def _gold_keys(gold: DataFrame, key: str, answer: str) -> DataFrame:
    """Per key: rows, and the least and greatest answer with NULL as a value of its own."""
    value = F.struct(F.col(answer).isNull().alias("none"), F.col(answer).alias(answer))
    return gold.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_gold"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def unique_gold(gold: DataFrame, key: str = "sample_id", answer: str = "gt_answer") -> DataFrame:
    """(key, answer), one row per key.  Equal rows of a key count once;
    keys with different answers are left to ``duplicate_gold``."""
    return (_gold_keys(gold, key, answer).where(F.col("least") == F.col("greatest"))
            .select(key, F.col(f"least.{answer}").alias(answer)))


def duplicate_gold(gold: DataFrame, key: str = "sample_id", answer: str = "gt_answer") -> DataFrame:
    """Keys whose gold rows disagree, with their number of rows."""
    return _gold_keys(gold, key, answer).where(F.col("least") != F.col("greatest")).select(key, "n_gold")


def with_image(samples: DataFrame, manifest: DataFrame, key: str = "image_id",
               skew_safe: bool = True) -> DataFrame:
    """Samples whose image file exists."""
    return _join(samples, manifest.select(key), key, "left_semi", skew_safe)


def missing_image(samples: DataFrame, manifest: DataFrame, key: str = "image_id",
                  skew_safe: bool = True) -> DataFrame:
    """Samples whose image file is missing (the reference job would die)."""
    return _join(samples, manifest.select(key), key, "left_anti", skew_safe)


def gold_from_samples(samples: DataFrame, answer: str = "answer") -> DataFrame:
    """Gold answers of a samples table (``sample_id``, ``gt_answer``)."""
    return samples.select("sample_id", F.col(answer).alias("gt_answer"))
