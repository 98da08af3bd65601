"""Labelled documents for the classifiers: a bounded sample, and the held-out fifth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import project


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by the CRC-32 of their decimal text; null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: Column, max_rows: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, text) of ``max_rows`` labelled documents at most, none of the
    held-out fifth; those whose ids have the smallest hashes.

    ``label`` is a column of ``labels``; rows where it or the id is null
    don't count.  The labels chosen are ``max_rows`` rows at most, so they
    are broadcast, and the documents are read once without a shuffle.  An id
    that documents repeat counts once, one that labels repeat has its largest
    label.
    """
    doc_id = labels["doc_id"].cast("long")
    chosen = (labels.select(doc_id.alias("doc_id"), label.alias("label"))
              .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    found = project(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max(F.struct("label", "text")).alias("x")).select("x.label", "x.text")
