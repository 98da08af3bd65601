"""Sinks: the per-sample evaluation report (S4) and the metrics table.

Writers are plain DataFrame writers, so every task writes its own files and
a lost executor only re-runs its tasks; the commit protocol makes a job's
output appear whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import set_conf

REPORT_SCHEMA = T.StructType([
    T.StructField("image_id", T.StringType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("gt_answer", T.StringType()),
    T.StructField("prediction_raw", T.StringType()),
    T.StructField("pred_think", T.StringType()),
    T.StructField("pred_answer", T.StringType()),
    T.StructField("is_correct", T.IntegerType()),
    T.StructField("is_consist", T.IntegerType()),
])

#: Folders that a task writes at a time; with more of them its rows are sorted by folder, as Spark does by default.
OPEN_FOLDERS = {"spark.sql.maxConcurrentOutputFileWriters": "64"}


#: The JSON writer has no name for zstd, but takes Parquet's codec class (files ``.zstd``).  A reader must be told of
#: it, or it takes such files for ones that it can split.
_CODEC = "org.apache.parquet.hadoop.codec.ZstandardCodec"
READ_ZSTD = {"io.compression.codecs": _CODEC}
ZSTD = {"compression": _CODEC, "parquet.compression.codec.zstd.level": "9"}
#: A writer of it holds about 20 MB, so a task has fewer at a time.
ZSTD_FOLDERS = dict.fromkeys(OPEN_FOLDERS, "16")


def write_eval_report(records: DataFrame, path: str, tag: str = "tag", mode: str = "overwrite", compression: str = "gzip") -> None:
    """JSON Lines, one folder per tag; NULL fields are written as null.

    Every row is written (the studied job kept only one process's rows).
    Rows hold a question and texts that repeat it, so the lines are compressed
    (``compression``: ``none`` for plain text, ``zstd`` to find texts again
    that gzip's 32 KB have lost, to be read by ``read_eval_report``).
    """
    options, folders = (ZSTD, ZSTD_FOLDERS) if compression == "zstd" else ({"compression": compression}, OPEN_FOLDERS)
    with set_conf(records.sparkSession, folders):
        (records.write.mode(mode).option("ignoreNullFields", "false").options(**options)
         .partitionBy(tag).json(path))


def read_eval_report(spark: SparkSession, path: str, tag: str = "tag") -> DataFrame:
    schema = T.StructType(REPORT_SCHEMA.fields + [T.StructField(tag, T.StringType())])
    return spark.read.schema(schema).options(**READ_ZSTD).json(path)


def write_metrics(metrics: DataFrame, path: str, partition_by: tuple[str, ...] = ("run_id",)) -> None:
    """Append scalar events to a Parquet table partitioned by run."""
    metrics.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
