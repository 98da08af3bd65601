"""Command line for the end-to-end jobs.

    python -m rubric.plans.cli score      --completions P --out O [--gold-col gt_answer]
    python -m rubric.plans.cli eval       --completions P --gold G --out O [--tag-col tag]
    python -m rubric.plans.cli advantage  --scored P --out O [--mean-only]
    python -m rubric.plans.cli prompts    --samples-config C.json --out O
    python -m rubric.plans.cli sequences  --prompts P --out O --max-length N [--vocabulary V]
    python -m rubric.plans.cli rollouts   --samples-config C.json --out O [--first-n N] [--generations G]
    python -m rubric.plans.cli checkpoints --metrics P --out O --eval-freq 2 --save-freq 6

Inputs are Parquet tables (samples: JSON Lines through a config shaped like
the studied one); every output is written as Parquet (the report as JSON
Lines).  Settings such as ``spark.checkpoint.dir`` come from spark-submit.
"""

from __future__ import annotations

import argparse
import json

from ..functions.fixed import GROUP_SIZE, METRIC_BATCH_LOSS, METRIC_PASS_RATE
from ..operators import prompts as P
from ..operators import runs as RU
from ..session import clear_scratch, get_session, scratch_mark
from ..sources import samples as SM
from . import jobs


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="rubric")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("score")
    a.add_argument("--completions", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--gold-col", default="gt_answer")
    a = sub.add_parser("eval")
    a.add_argument("--completions", required=True)
    a.add_argument("--gold", required=True, help="table with sample_id, gt_answer")
    a.add_argument("--out", required=True)
    a.add_argument("--tag-col", default="tag")
    a = sub.add_parser("advantage")
    a.add_argument("--scored", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--mean-only", action="store_true")
    a = sub.add_parser("prompts")
    a.add_argument("--samples-config", required=True, help="JSON: image_dir, <split>_image_dir, pipeline.<split>.<split>_file")
    a.add_argument("--out", required=True)
    a = sub.add_parser("sequences")
    a.add_argument("--prompts", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--max-length", type=int, default=2048)
    a.add_argument("--label-mode", default="default", choices=["default", "compatible"])
    a.add_argument("--vocabulary", help="table with token, id; built from the prompts if not given")
    a = sub.add_parser("rollouts")
    a.add_argument("--samples-config", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--first-n", type=int)
    a.add_argument("--generations", type=int, default=GROUP_SIZE)
    a = sub.add_parser("checkpoints")
    a.add_argument("--metrics", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--eval-freq", type=int, default=2)
    a.add_argument("--save-freq", type=int, default=6)
    args = ap.parse_args(argv)

    spark, mark = get_session(app=f"rubric-{args.cmd}"), scratch_mark()
    if args.cmd == "score":
        jobs.score_job(spark.read.parquet(args.completions), args.out, gold=args.gold_col)
    elif args.cmd == "eval":
        jobs.eval_job(spark, spark.read.parquet(args.completions), spark.read.parquet(args.gold), args.out,
                      tag=args.tag_col)
    elif args.cmd == "advantage":
        jobs.advantage_job(spark.read.parquet(args.scored), args.out, scale_rewards=not args.mean_only)
    elif args.cmd == "prompts":
        with open(args.samples_config) as f:
            cfg = json.load(f)
        P.build_prompts(SM.read_splits(spark, cfg)).drop("messages", "prompt_messages", "ord") \
            .write.mode("overwrite").partitionBy("split").parquet(args.out)
    elif args.cmd == "sequences":
        vocab = spark.read.parquet(args.vocabulary) if args.vocabulary else None
        jobs.sequences_job(spark.read.parquet(args.prompts), args.out, args.max_length, mode=args.label_mode, vocab=vocab)
    elif args.cmd == "rollouts":
        with open(args.samples_config) as f:
            cfg = json.load(f)
        jobs.rollout_job(SM.read_split(spark, cfg, "train"), SM.split_image_dir(cfg, "train"), args.out, args.generations,
                         args.first_n)
    elif args.cmd == "checkpoints":
        metrics = spark.read.parquet(args.metrics)
        RU.require_metrics(metrics, METRIC_PASS_RATE, METRIC_BATCH_LOSS)
        RU.best_checkpoint_names(metrics, args.eval_freq, args.save_freq).write.mode("overwrite").parquet(args.out)
    clear_scratch(spark, mark)


if __name__ == "__main__":
    main()
