"""Readers for the parquet test tables and the tables we derive from them.

``documents`` holds no tagged completions, so samples, completions and
metrics are derived from ``documents`` and ``events`` by fixed rules (the
same rules are written as SQL for the DuckDB oracle).  Every derivation is a
projection or a narrow fan-out, so its work grows with the input tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# The twelve completion shapes: good, wrong, inconsistent, long, no think,
# unclosed answer, upper case, no tags, many synonyms, blank answer,
# tool call, two answers.
N_SHAPES = 12


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Set by a caller whose input files have fewer splits than the cluster has cores (the test tables are one row
#: group each): the number of partitions that derived samples are dealt to.  Unset: the scan's own splits.
INPUT_PARTITIONS = "spark.rubric.inputPartitions"


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the caller asked for, if any."""
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per document (question and CoT are the whole document
    text); ``image_id`` repeats (two documents per image) and one CoT in
    ten is NULL."""
    return dealt(derive_samples(read_table(spark, sf_dir, "documents")))


def derive_samples(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    answer = (F.when(doc % 6 == 0, "yes").when(doc % 6 == 1, "no").when(doc % 6 == 2, "left")
              .when(doc % 6 == 3, "right").when(doc % 6 == 4, "Red").otherwise("red car"))
    return documents.select(
        doc.alias("sample_id"),
        F.floor(doc / 2).cast("bigint").cast("string").alias("image_id"),
        F.col("text").alias("question"),
        answer.alias("answer"),
        F.when(doc % 10 == 9, F.lit(None).cast("string")).otherwise(F.col("text")).alias("cot_text"),
    )


def fan_out(df: DataFrame, g: int = fixed.GROUP_SIZE, name: str = "gen_idx") -> DataFrame:
    """Each row repeated ``g`` times with a generation index.

    ``explode(sequence)`` is a narrow Generate: no shuffle, no join.
    """
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias(name))


def completions_from_samples(s: DataFrame, g: int = fixed.GROUP_SIZE) -> DataFrame:
    """Six synthetic completions per sample, one of twelve shapes each."""
    r = fan_out(s.select("sample_id", "image_id", "question", "answer"), g)
    k = (F.col("sample_id") * 7 + F.col("gen_idx") * 5) % N_SHAPES
    a, q, nl = F.col("answer"), F.col("question"), F.lit("\n")
    shapes = [
        F.concat(F.lit("<think>"), nl, F.lit("I see "), a, F.lit(", "), q, nl, F.lit("</think>"), nl,
                 F.lit("<answer>"), nl, a, F.lit("."), nl, F.lit("</answer>")),
        F.concat(F.lit("<think>"), q, F.lit("</think><answer>purple</answer>")),
        F.concat(F.lit("<think>xyzzy</think><answer>"), a, F.lit("</answer>")),
        F.concat(F.lit("<think>so "), a, F.lit("</think><answer>It must surely be "), a, F.lit("</answer>")),
        F.concat(F.lit("<answer>"), a, F.lit("</answer>")),
        F.concat(F.lit("<think>so "), a, F.lit("</think><answer>"), a, nl),
        F.concat(F.lit("<THINK>so "), a, F.lit("</THINK><ANSWER>"), F.upper(a), F.lit("</ANSWER>")),
        q,
        F.lit("<think>true, not west or east</think><answer>true, not west or east</answer>"),
        F.concat(F.lit("<think>so "), a, F.lit("</think><answer> </answer>")),
        F.concat(F.lit("<tool_call>x</tool_call><think>so "), a, F.lit("</think><answer>"), a,
                 F.lit("</answer>")),
        F.concat(F.lit("<answer>"), a, F.lit("</answer><answer>purple</answer>")),
    ]
    expr = None
    for i, shape in enumerate(shapes[:-1]):
        expr = F.when(k == i, shape) if expr is None else expr.when(k == i, shape)
    expr = expr.otherwise(shapes[-1])
    return r.select("sample_id", "image_id", "question", "answer", "gen_idx",
                    expr.alias("completion"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completions table with its gold answer column ``answer``."""
    return completions_from_samples(samples(spark, sf_dir))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training scalars derived from ``events``, one per event."""
    return derive_metrics(read_table(spark, sf_dir, "events"))


#: Event type -> metric it stands for; any other type keeps its own name.
EVENT_METRICS = {"view": fixed.METRIC_BATCH_LOSS, "click": fixed.METRIC_PASS_RATE, "purchase": fixed.METRIC_EPOCH_LOSS,
                 "signup": fixed.METRIC_SAMPLE_OK}


def derive_metrics(events: DataFrame) -> DataFrame:
    """Losses are the event's value; a pass rate is value / (value + 10),
    between 0 and 1; an outcome is 1.0 when the value exceeds 10."""
    et, v = F.col("event_type"), F.col("value")
    name, value = et, F.when(et == "click", v / (v + 10)).when(et == "signup", F.when(v > 10, 1.0).otherwise(0.0)).otherwise(v)
    for event, metric in EVENT_METRICS.items():
        name = F.when(et == event, F.lit(metric)).otherwise(name)
    return events.select((F.col("user_id") % 5).alias("run_id"), (F.lit(1) + F.col("event_id") % 12).alias("epoch"),
                         F.col("event_id").alias("step"), name.alias("name"), value.alias("value"), F.col("ts"))
