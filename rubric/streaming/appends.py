"""Scalars appended while they are recorded (S5 on streams).

Each micro-batch writes a part of its own, named by its number, so a batch
that is run again overwrites only itself.  Parts are merged ``every`` at a time,
merged parts again, and so on, like the carries of a counter: after N batches
there are at most ``every`` parts of each of log(N) sizes, however long the
stream runs.  A merged part takes the place of its own parts once it is
finished; those are deleted a batch later, so a reader that has just listed
them can still read them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .streams import _checkpoint, _start

EVERY = 10
#: Bytes of a merged part's files.
FILE = 128 << 20
_PART = re.compile(r"part-(\d+)-(\d+)$")


def part_folder(path: str, first: int, last: int) -> str:
    return f"{path}/part-{first:012d}-{last:012d}"


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration())


def finished_parts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first batch, last batch) of all parts that are written completely."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*/_SUCCESS")
    found = _files(spark, path).globStatus(marks) or []
    return sorted(tuple(map(int, _PART.search(f.getPath().getParent().getName()).groups())) for f in found)


def covering(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The largest parts: each batch once."""
    out, upto = [], -1
    for first, last in sorted(parts, key=lambda p: (p[0], -p[1])):
        if first > upto:
            out.append((first, last))
            upto = last
    return out


def _merge(spark: SparkSession, path: str, first: int, last: int) -> None:
    parts = finished_parts(spark, path)
    if (first, last) in parts:
        return
    inside = covering([p for p in parts if first <= p[0] and p[1] <= last])
    names = [part_folder(path, *p) for p in inside]
    size = sum(_files(spark, path).getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(n)).getLength() for n in names)
    rows = spark.read.parquet(*names)
    rows.coalesce(max(1, size // FILE)).write.mode("overwrite").parquet(part_folder(path, first, last))


def append_stream(stream: DataFrame, path: str, every: int = EVERY, checkpoint: str | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Rows of ``stream`` (recorded scalars) appended below ``path``, each
    once, also over restarts with the same ``checkpoint``.  ``appended`` reads them."""
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        parts = finished_parts(spark, path)
        kept = set(covering([p for p in parts if p[1] < epoch]))
        for p in parts:
            if p[1] < epoch and p not in kept:
                _files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(part_folder(path, *p)), True)
        batch.write.mode("overwrite").parquet(part_folder(path, epoch, epoch))
        size = every
        while (epoch + 1) % size == 0:
            _merge(spark, path, epoch + 1 - size, epoch)
            size *= every

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", _checkpoint(spark, "append", checkpoint))
    return _start(w, available_now)


def appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished batches."""
    return spark.read.parquet(*[part_folder(path, *p) for p in covering(finished_parts(spark, path))])
