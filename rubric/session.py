"""Spark session and shared-folder helpers.

Jobs never pick a machine-local folder on a cluster: anything that must be
materialised (a checkpoint that cuts lineage, a scratch table written by a
source test) goes under the folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (local runs and
tests) do we set one of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on.  AQE gives runtime broadcast conversion
# (a size-checked broadcast with a sort-merge fallback), skew-join splitting
# and partition coalescing; UTC keeps event-time arithmetic engine-neutral.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

_SCRATCH: list[str] = []


def get_session(master: str | None = None, app: str = "rubric",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    ``master`` and ``shuffle_partitions`` are only applied when given, so on a
    cluster the submit-time values win.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a Spark Connect session (no SparkContext in Python) the server's
    ``spark.checkpoint.dir`` setting is used as is."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect
        try:
            return spark.conf.get("spark.checkpoint.dir", None)
        except Exception:
            return None
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="rubric-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder, until ``clear_scratch``."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append(path)
    return path


def scratch_mark() -> int:
    """A mark for ``clear_scratch``: folders named later come after it."""
    return len(_SCRATCH)


def clear_scratch(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Delete the folders that ``scratch_path`` named in this process since
    the mark, but those of ``keep``; call it when no DataFrame over them is
    read any more (the end of a job, a benchmark or a test run).  Returns
    their number."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for name in [x for x in _SCRATCH[since:] if x not in keep]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
        _SCRATCH.remove(name)
    return n


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def set_conf(spark: SparkSession, settings: dict[str, str]):
    """``settings`` hold inside; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application).

    Python UDFs pickle module-level functions by reference, so workers must
    be able to import them.  The package is zipped on the driver and shipped
    with ``addPyFile`` - the usual way to distribute job code to executors.
    """
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: ship as an artifact instead
        sc = None
    app = sc.applicationId if sc is not None else "connect"
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="rubric-pyfiles-"), "rubric.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(app)
