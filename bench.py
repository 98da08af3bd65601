"""Benchmark the headline jobs; prints one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver).  Every job runs three times: a first
(cold) pass that pays JVM JIT and code generation, then two warm passes;
``queries`` reports each job's faster warm time and ``value`` their sum.
The cold times are kept under ``cold``.  No data is cached between passes
(each pass rebuilds every plan from the parquet files).  Environment: BENCH_SF_DIR
(default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rubric.plans import catalog  # noqa: E402
from rubric.session import clear_scratch, get_session  # noqa: E402
from rubric.sources.tables import INPUT_PARTITIONS  # noqa: E402

HEADLINE = [
    ("score", "score_completions"),          # SCORE: T1-T8, R1-R3
    ("advantage", "r6_group_advantage"),     # ADVANTAGE: R6
    ("group_audit", "r7_group_audit"),       # ADVANTAGE: R7
    ("eval_labelled", "j2_eval_labelled"),   # EVAL: J2 + A1/A2
    ("eval_by_tag", "a4_eval_by_tag"),       # EVAL: A4
    ("eval_records", "p10_eval_records"),    # EVAL: P10
    ("prompts", "p8_render_chat"),           # PROMPTS: P1-P8
    ("seq", "q4_label_mask"),                # SEQ: Q1-Q4
    ("vocabulary", "q2_vocabulary"),         # SEQ: Q2
    ("batches", "w2_batch_ids"),             # W1-W2 global index
    ("epoch_loss", "a5_epoch_loss"),         # RUNS: A5
    ("checkpoints", "w6_checkpoint_name"),   # RUNS: W4-W6
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app="rubric-bench", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": "16g", INPUT_PARTITIONS: str(2 * cpus)})
    def run_pass() -> dict[str, float]:
        times: dict[str, float] = {}
        for label, name in HEADLINE:
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[label] = round(time.perf_counter() - t0, 3)
            clear_scratch(spark)
        return times

    cold = run_pass()
    warm1, warm2 = run_pass(), run_pass()
    warm = {k: min(warm1[k], warm2[k]) for k in warm1}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      "cold": cold, "cold_total": round(sum(cold.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
