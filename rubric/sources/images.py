"""Image manifest (S3): which image files exist, without decoding them.

Selecting only path, length and modification time prunes the ``content``
column of ``binaryFile``, so no image bytes are read.  The id is taken from
the file path by a regex.  Files are listed a part of the folders at a time,
as the driver's file index has an entry for each, and the parts go to one
table that the joins (J1) read - they take any table with an image id.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, set_conf, ship_package
from .files import located

DEFAULT_GLOB = "*.jpg"
DEFAULT_ID_PATTERN = r"([^/]+)\.jpg$"
# layout written by ``write_image_files``: <dir>/<folder>/image_id=<id>.txt
PARTITIONED_ID_PATTERN = r"image_id=([^/]+)\.txt$"
#: Files of a folder that ``write_image_files`` writes, about.
FILES = 1000
#: Folders that one task writes, about.
TASK_FOLDERS = 8
#: Folders listed first; then as many at a time as have about so many files, since the driver's file index has an entry for each.
FOLDERS, LISTED = 50, 50_000
#: Listed files that one task writes, about.
TASK_FILES = 1000
#: The session keeps no listings: each folder is listed once.
NO_CACHE = {"spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
#: The name of a NULL id, as in the folders of Spark's writers.
NULL_ID = "__HIVE_DEFAULT_PARTITION__"


def image_manifest(spark: SparkSession, image_dir: str, glob: str = DEFAULT_GLOB,
                   id_pattern: str = DEFAULT_ID_PATTERN) -> DataFrame:
    """S3: (image_id, path, length, modificationTime), one row per file, as a
    table that is written when this is called."""
    table = scratch_path(spark, "image-files")
    folders, files = children(spark, image_dir)

    def listed(paths: list[str]) -> int:
        found = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths))
        found.select(F.regexp_extract("path", id_pattern, 1).alias("image_id"), "path", "length", "modificationTime") \
            .write.mode("append").parquet(table)
        return len(found._jdf.inputFiles())

    with set_conf(spark, {**NO_CACHE, "spark.sql.files.openCostInBytes": str(open_cost(spark))}):
        if not folders:
            listed([image_dir])
            return spark.read.parquet(table)
        # Files beside folders are named: a reader of the folder itself lists all that is below it.
        for i in range(0, len(files), LISTED):
            listed(files[i:i + LISTED])
        first, size, seen = 0, FOLDERS, 0
        while first < len(folders):
            seen += listed(folders[first:first + size])
            first += size
            size = min(max(LISTED * first // max(seen, 1), 1), 10 * size)
    return spark.read.parquet(table)


def open_cost(spark: SparkSession) -> int:
    """What a file counts for when files are dealt to tasks: about a thousand make a task of the session's size."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(size // TASK_FILES, 1)


def children(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """The folders directly below ``folder`` that readers look into, and the files there; none if some name would be read as a pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        spark._jvm.org.apache.hadoop.fs.Path(path, "*")) or []
    if not any(f.isDirectory() for f in found):
        return [], []
    folders, files = [], []
    for f in found:
        name = str(f.getPath().toString())
        if not f.isDirectory():
            files.append(name)
        elif f.getPath().getName()[0] not in "_.":
            folders.append(name)
    odd = any(c in n for n in [folder, *folders, *files] for c in "{}[]*?\\")
    return ([], []) if odd else (sorted(folders), sorted(files))


def write_image_files(images: DataFrame, path: str, files: int = FILES) -> None:
    """Write one small file per image id (test input for S3/J1).

    ``images`` has ``image_id`` and a string ``content``, written as a line;
    rows are made distinct first.  A folder takes about ``files`` of the ids,
    by their hash, so a task that runs again writes the same files.
    """
    spark = images.sparkSession
    ship_package(spark)
    rows = images.select(F.coalesce(F.col("image_id"), F.lit(NULL_ID)).alias("image_id"), F.coalesce("content", F.lit("")).alias("content")).distinct()
    folders = -(-rows.count() // files) or 1
    # Ids are short, files are not: tasks are as many as the folders ask for, however few bytes the ids have.
    dealt = rows.select(F.pmod(F.xxhash64("image_id"), F.lit(folders)).cast("string").alias("folder"), "image_id", "content") \
        .repartition(-(-folders // TASK_FOLDERS), "folder")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(path)
        made: set[str] = set()
        for batch in batches:
            for folder, image, content in zip(*(c.to_pylist() for c in batch.columns)):
                if folder not in made:
                    system.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{folder}/image_id={quote(image, safe='')}.txt") as f:
                    f.write((content + "\n").encode())
        yield from ()

    dealt.mapInArrow(write, "folder string").write.format("noop").mode("overwrite").save()
