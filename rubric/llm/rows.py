"""Helpers shared by the operators of this subpackage.

Every operator reads its two or three input columns by name and drops the
rest first (``project``), so extra columns of any name, also names the
operator uses itself, never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import clear_scratch, scratch_path, ship_package

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def project(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), null texts as empty texts."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Lineage is cut there: a lost executor costs a re-read of the files, not
    a re-run of what led to them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables written since the mark (``session.scratch_mark``) but ``keep``."""
    clear_scratch(spark, since, tuple(df.scratch for df in keep))


def python_ready(spark: SparkSession) -> None:
    """The package's modules can be imported by Python workers."""
    ship_package(spark)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text) ``kept`` names, one for each
    such pair.  ``kept`` holds doc_id and ``text_sha256`` (lower-case hex).

    Null ids match null ids.  The join and the removal of repeated rows need
    the same partitioning, so whole rows move once.
    """
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"),
                       F.sha2(F.coalesce(docs["text"], F.lit("")), 256).alias("sha"))
    right = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    same = left["id"].eqNullSafe(right["kept_id"]) & (left["sha"] == right["kept_sha"])
    return left.join(right, same, "left_semi").dropDuplicates(["id", "sha"]).select("row.*")
