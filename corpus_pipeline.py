"""Corpus pipeline: raw documents to packed training sequences.

``run`` applies ``STAGES`` in order; each stage's rows are written as Parquet
in the shared folder and read again as the next one's documents.  The models
are fitted on the labelled documents among those that a stage is given.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rubric.llm import exact_dedup, jaccard_join, packing, quality, queries, toxicity
from rubric.llm.rows import forget, keep_rows, written
from rubric.session import scratch_mark


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is at least ``quality.GOOD`` more likely than not."""
    labels = queries.table(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.train(docs, labels, quality.graded(labels)))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, queries.table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id."""
    return keep_rows(docs, exact_dedup.exact_dedup(docs).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, 0.8): the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path(queries.WORD_BPE))


STAGES = [("quality", good), ("toxicity", clean), ("exact_dedup", exact), ("jaccard_join", near), ("packing", pack)]

#: SQL can express neither the models nor the tokenizer; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
