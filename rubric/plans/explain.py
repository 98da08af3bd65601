"""Plan report: run the headline queries and summarise their final
(adaptive) physical plans - exchanges, joins, aggregates, windows, Python
evaluation and what each scan reads.  ``python -m rubric.plans.explain``
writes PLANS.md at the repository root.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
from collections import Counter

from . import catalog

HEADLINE = ["score_completions", "r6_group_advantage", "r7_group_audit", "j2_eval_labelled",
            "a4_eval_by_tag", "w7_worst_samples", "p8_render_chat", "q2_vocabulary", "q4_label_mask",
            "w2_batch_ids", "w6_checkpoint_name", "j1_with_image", "x3_windowed_mean_stream"]

_NODES = ["SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
          "CartesianProduct", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window",
          "WindowGroupLimit", "TakeOrderedAndProject", "Generate", "BatchEvalPython", "ArrowEvalPython",
          "Subquery"]


def final_plan(plan: str) -> str:
    """The plan that ran, scalar subqueries included: initial plans, of the
    query and of its subqueries, are left out (their lines are indented
    below the marker)."""
    kept, below = [], None
    for line in plan.split("\n"):
        if below is not None and len(line) > below and line[below] == " ":
            continue
        below = line.find("+- == Initial Plan ==")
        if below < 0:
            below = None
            kept.append(line)
    return "\n".join(kept)


def summarise(plan: str) -> dict:
    plan = final_plan(plan)
    exchanges = Counter()
    for m in re.finditer(r"Exchange (\w+)(?:\(([^)]*)\))?", plan):
        kind = m.group(1)
        if kind == "hashpartitioning" and m.group(2):
            keys = ", ".join(k.split("#")[0] for k in m.group(2).split(", ")[:-1])
            kind = f"hash({keys})"
        exchanges[kind] += 1
    nodes = Counter()
    for n in _NODES:
        nodes[n] = len(re.findall(rf"\b{n}\b", plan))
    scans = []
    for line in plan.split("\n"):
        if "FileScan" not in line:
            continue
        loc = re.search(r"Location: \w+\([^)]*\)\[([^\]]*)\]", line)
        table = os.path.basename(loc.group(1).split(",")[0].rstrip("/")) if loc else "?"
        schema = re.search(r"ReadSchema: (struct<.*?>)(?:$|,? \w+:)", line)
        pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", line)
        scans.append((table, schema.group(1) if schema else "?", pushed.group(1) if pushed else ""))
    return {"exchanges": exchanges, "nodes": {k: v for k, v in nodes.items() if v},
            "scans": sorted(Counter(scans).items())}


def report(spark, sf_dir: str, names=HEADLINE) -> str:
    out = ["# PLANS", "",
           f"Final adaptive plans of the headline queries at `{sf_dir}`, generated by "
           "`python -m rubric.plans.explain`. Counts cover the final plan with its scalar subqueries; a scan counts as often as it ran.", ""]
    for name in names:
        df = catalog.QUERIES[name](spark, sf_dir)
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()            # after execution: AQE's final plan
        plan = buf.getvalue()
        s = summarise(plan)
        out.append(f"## `{name}`")
        out.append("")
        ex = ", ".join(f"{k} x{v}" for k, v in sorted(s["exchanges"].items())) or "none"
        out.append(f"- exchanges: {ex}")
        out.append("- operators: " + (", ".join(f"{k} x{v}" for k, v in sorted(s["nodes"].items())) or "projections only"))
        for (table, cols, pushed), n in s["scans"]:
            out.append(f"- scan `{table}` x{n}: `{cols}`" + (f"; pushed filters `[{pushed}]`" if pushed else ""))
        out.append("")
    return "\n".join(out)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from ..session import get_session
    spark = get_session("local[8]", app="rubric-plans", shuffle_partitions=8)
    sf = os.environ.get("PLANS_SF_DIR", "/root/testdata/sf0.01")
    text = report(spark, sf)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with open(os.path.join(root, "PLANS.md"), "w") as f:
        f.write(text + "\n")
    print(text)


if __name__ == "__main__":
    main()
