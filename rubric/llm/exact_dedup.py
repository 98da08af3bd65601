"""Exact deduplication with an extendible-hash index on shared files.

1. Bytes are compared by a grouped aggregate on (hash, text).  Its partial
   half runs in the map tasks, so a text that makes up a third of the table
   leaves each task as one row.
2. One index entry for each distinct text: 64-bit hash, digest, the row that
   stays and the number of copies.  Entries with one hash and different
   bytes form a chain.
3. The directory maps the top bits of a hash to a bucket.  It starts with
   one bucket; as long as a bucket holds more than ``capacity`` entries it
   is split by one more bit, which doubles the directory, down to
   ``max_depth`` bits (a bucket that is still too full stays as it is, and
   only gets longer).  So the directory has 2 ** max_depth cells at most and
   may be broadcast.
4. Owner tasks take ranges of buckets and write the index files, sorted by
   (bucket, hash, chain).
5. Each row looks its bucket up in the directory and finds its chain entry.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_mark
from .rows import forget, project, written

CAPACITY = 8192
MAX_DEPTH = 14


def cell(h: Column, max_depth: int) -> Column:
    """The top ``max_depth`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - max_depth).cast("int")


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(cell, depth, bucket) for each cell that has entries.

    ``entries`` has the column ``h``.  The bucket at depth d of a cell holds
    all cells with the same first d bits; a cell's depth is the first at
    which that bucket holds ``capacity`` entries or fewer.  ``bucket``
    numbers grow with the hash, so ranges of buckets are ranges of hashes.
    """
    cells = entries.groupBy(cell(F.col("h"), max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    depths = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    prefix = F.expr(f"shiftright(cell, {max_depth} - depth)")
    held = (depths.groupBy("depth", prefix.alias("prefix"))
            .agg(F.sum("n").alias("held"), F.collect_list("cell").alias("cells")))
    fits = (F.col("held") <= F.lit(capacity)) | (F.col("depth") == F.lit(max_depth))
    return (held.where(fits).select("depth", "prefix", F.explode("cells").alias("cell"))
            .groupBy("cell").agg(F.min(F.struct("depth", "prefix")).alias("leaf"))
            .select("cell", F.col("leaf.depth").alias("depth"),
                    F.expr(f"shiftleft(leaf.prefix, {max_depth} - leaf.depth)").alias("bucket")))


def build_index(keyed: DataFrame, capacity: int = CAPACITY,
                max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(index, directory), both written to the shared folder.

    ``keyed`` has doc_id, text and h.  The index has one row for each
    distinct text: bucket, h, chain, digest (binary), keep_id, group_size.
    """
    texts = keyed.groupBy("h", "text").agg(F.max("doc_id").alias("keep_id"),
                                           F.count(F.lit(1)).alias("group_size"))
    spark, mark = keyed.sparkSession, scratch_mark()
    entries = written(texts.select("h", F.unhex(F.sha2("text", 256)).alias("digest"), "keep_id", "group_size"),
                      "dedup-entries")
    cells = written(directory(entries, capacity, max_depth), "dedup-directory")
    chained = Window.partitionBy("bucket", "h").orderBy("digest")
    index = (entries.join(F.broadcast(cells), cell(F.col("h"), max_depth) == cells["cell"])
             .select("bucket", "h", (F.row_number().over(chained) - 1).alias("chain"),
                     "digest", "keep_id", "group_size")
             .repartitionByRange("bucket", "h", "chain").sortWithinPartitions("bucket", "h", "chain"))
    index = written(index, "dedup-index")
    forget(spark, mark, index, cells)
    return index, cells


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept,
    text_sha256, bucket, chain.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty.
    Of equal texts the row with the largest doc_id stays; a null id is
    smaller than any other and stays only if the whole group has none.  Rows
    that repeat both doc_id and text are one document: each says the same.
    An empty table gives an empty result.
    """
    keyed = project(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("h"))
    index, cells = build_index(keyed, capacity, max_depth)
    rows = (keyed.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("digest"))
            .join(F.broadcast(cells.select("cell", "bucket")), cell(F.col("h"), max_depth) == F.col("cell")))
    found = rows.join(index, ["bucket", "h", "digest"])
    return found.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "bucket", "chain")
