"""SCORE job: completions -> parsed, matched and rewarded rows.

Narrow only: every step is a projection, so the job never shuffles and
scales with the number of input splits.  Work is staged over several
``select``s so each extraction, cleaning and tokenisation is computed once
per row (Catalyst keeps a non-cheap expression that is referenced twice in
its own projection instead of inlining it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import rewards as R
from ..functions import text as T

SCORED_COLUMNS = ["pred_think", "pred_answer", "is_correct", "is_consist", "is_concise",
                  "format_reward", "main_reward", "reward"]


def parse_completions(df: DataFrame, completion: str = "completion") -> DataFrame:
    """T1 only: add ``pred_think`` and ``pred_answer`` (NULL text -> '')."""
    text = F.coalesce(F.col(completion), F.lit(""))
    return df.select("*", T.extract_think(text).alias("pred_think"),
                     T.extract_answer(text).alias("pred_answer"))


def score_completions(df: DataFrame, completion: str = "completion",
                      gold: str = "gt_answer", groups: T.Groups = fixed.SYNONYM_GROUPS) -> DataFrame:
    """Add the scored columns of the SCORE job.  ``groups``: synonyms (T4).

    * ``is_correct`` = T5(answer, gold); ``is_consist`` = T5(think, gold) only
      when correct (evaluation rule, T8).
    * ``main_reward`` uses the reward rule for consistency (empty think is
      neutral there), ``reward`` = float32(format + main) (R3).
    * A NULL gold gives NULL flags and rewards: such rows are rejects, not
      counted by the aggregates (``count`` skips NULL).
    """
    cols = df.columns
    text = F.coalesce(F.col(completion), F.lit(""))
    s1 = df.select(
        "*",
        T.extract_think(text).alias("pred_think"),
        T.extract_answer(text).alias("pred_answer"),
        T.clean_text(F.col(gold)).alias("_gold_clean"),
        R.format_reward(text).alias("format_reward"),
    )
    s2 = s1.select(
        "*",
        T.synonym_group_words(F.col("_gold_clean"), groups).alias("_gold_group"),
        T.clean_text(F.col("pred_answer")).alias("_ans_clean"),
        T.n_words(F.col("pred_answer")).alias("_ans_words"),
    )
    s3 = s2.select(
        "*",
        T.match_prepared("_ans_clean", T.tokens(F.col("_ans_clean")),
                         "_gold_clean", "_gold_group").alias("_ans_ok"),
    )
    # The think part only matters when the answer is right (T8 and R2), so
    # the (possibly long) CoT is cleaned and tokenised only for those rows;
    # CASE WHEN evaluates its branch lazily.
    s4 = s3.select("*", F.when(F.col("_ans_ok"), T.clean_text(F.col("pred_think"))).alias("_think_clean"))
    s5 = s4.select(
        "*",
        F.when(F.col("_ans_ok"),
               T.match_prepared("_think_clean", T.tokens(F.col("_think_clean")),
                                "_gold_clean", "_gold_group")).alias("_think_ok"),
    )
    gold_null = F.col(gold).isNull()
    is_correct = F.col("_ans_ok").cast("int")
    is_consist = F.when(F.col("_ans_ok"), F.col("_think_ok").cast("int")).otherwise(F.lit(0))
    main = R.correctness_consistency_reward("pred_think", "pred_answer", "_ans_ok",
                                            "_think_ok", "_ans_words")
    s6 = s5.select(
        *cols, "pred_think", "pred_answer",
        is_correct.alias("is_correct"),
        F.when(gold_null, F.lit(None).cast("int")).otherwise(is_consist).alias("is_consist"),
        (F.col("_ans_words") <= F.lit(fixed.LONG_ANSWER_WORDS)).cast("int").alias("is_concise"),
        F.when(gold_null, F.lit(None).cast("double")).otherwise(F.col("format_reward"))
         .alias("format_reward"),
        F.when(gold_null, F.lit(None).cast("double")).otherwise(main).alias("main_reward"),
    )
    return s6.select("*", R.combined_reward("format_reward", "main_reward").alias("reward"))


def strict_parse(df: DataFrame, completion: str = "completion") -> DataFrame:
    """The generation-time parser (case-sensitive, closed tags)."""
    text = F.coalesce(F.col(completion), F.lit(""))
    return df.select("*", T.extract_strict_cot(text).alias("strict_cot"),
                     T.extract_strict_answer(text).alias("strict_answer"))


def tag_policy(df: DataFrame, completion: str = "completion") -> DataFrame:
    """Flag tool calls and foreign tags."""
    text = F.coalesce(F.col(completion), F.lit(""))
    return df.select("*", T.has_tool_call(text).cast("int").alias("has_tool_call"),
                     F.array_join(T.foreign_tags(text), ",").alias("foreign_tags"),
                     T.violates_tag_policy(text).cast("int").alias("tag_violation"))
