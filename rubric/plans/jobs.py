"""End-to-end jobs as a user runs them on a cluster.

Each job writes its output table and reads it back for the next step, so a
consumer reads columnar data instead of recomputing the scoring, and a lost
executor only re-runs tasks of the current stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluation as E
from ..operators import groups as G
from ..operators import joins as J
from ..operators import prompts as P
from ..operators import scoring as S
from ..operators import sequences as Q
from ..sources import sinks as SK
from ..sources import tables as TB


def score_job(completions: DataFrame, out: str, gold: str = "gt_answer",
              partition_by: tuple[str, ...] = ()) -> DataFrame:
    """SCORE: write the scored table (narrow job, no shuffle); return it as read back."""
    w = S.score_completions(completions, gold=gold).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(out)
    return completions.sparkSession.read.parquet(out)


def eval_job(spark: SparkSession, completions: DataFrame, gold: DataFrame, out_dir: str,
             tag: str = "tag") -> dict[str, DataFrame]:
    """EVAL: J2 -> SCORE (written once) -> S4 report and A4 rates.

    What cannot be paired is written rather than dropped: completions
    without gold (``unmatched``), gold without completions
    (``unmatched_gold``), keys with several gold answers (``duplicate_gold``).
    Completions carry the rendered ``instruction``, or the bare ``question``.
    """
    J.duplicate_gold(gold).write.mode("overwrite").parquet(f"{out_dir}/duplicate_gold")
    J.unmatched_gold(gold, completions).write.mode("overwrite").parquet(f"{out_dir}/unmatched_gold")
    unique = J.unique_gold(gold)
    J.unmatched_completions(completions, unique).write.mode("overwrite").parquet(f"{out_dir}/unmatched")
    scored = score_job(J.attach_gold(completions, unique), f"{out_dir}/scored")
    rendered = "instruction" in completions.columns
    SK.write_eval_report(E.eval_records(scored, instruction="instruction" if rendered else "question", gold="gt_answer",
                                        extra=(tag,), rendered=rendered),
                         f"{out_dir}/report", tag=tag)
    rates = E.eval_by_tag(scored, tag)
    rates.write.mode("overwrite").parquet(f"{out_dir}/rates")
    return {"scored": scored, "rates": spark.read.parquet(f"{out_dir}/rates")}


def sequences_job(prompts: DataFrame, out: str, max_length: int, mode: str = "default",
                  vocab: DataFrame | None = None) -> DataFrame:
    """SEQ: prompts are tokenised once, into coded blocks; the vocabulary
    (unless given) counts whole texts there, and the sequences take their first ``max_length`` ids."""
    spark = prompts.sparkSession
    coded = Q.code_tokens(Q.tokenise(prompts), carry=("split", "prompt_len"))
    if vocab is None:
        Q.build_vocabulary_of(coded).write.mode("overwrite").parquet(f"{out}/vocabulary")
        vocab = spark.read.parquet(f"{out}/vocabulary")
    Q.pad_sequences(Q.encode_blocks(coded, vocab), max_length, mode=mode).write.mode("overwrite").parquet(f"{out}/sequences")
    return spark.read.parquet(f"{out}/sequences")


def rollout_job(samples: DataFrame, image_dir: str, out: str, generations: int, n: int | None = None) -> DataFrame:
    """ROLLOUT: P9 prompts of all samples (or the first ``n``), each fanned out to ``generations`` rows."""
    TB.fan_out(P.rollout_prompts(samples, image_dir, n=n), generations).write.mode("overwrite").parquet(out)
    return samples.sparkSession.read.parquet(out)


def advantage_job(scored: DataFrame, out: str, key: str = "sample_id", scale_rewards: bool = True) -> DataFrame:
    """ADVANTAGE: R6 over an already written scored table, plus the R7 audit."""
    G.group_advantage(scored, key=key, scale_rewards=scale_rewards).write.mode("overwrite").parquet(f"{out}/advantage")
    G.group_audit(scored, key=key).write.mode("overwrite").parquet(f"{out}/audit")
    return scored.sparkSession.read.parquet(f"{out}/advantage")
