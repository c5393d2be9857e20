"""SparkSession defaults for the library.

On a cluster the session comes from the platform; ``get_spark`` only fills
settings that are unset. AQE stays on so join strategy (broadcast vs
sort-merge), partition coalescing and skew-join splitting are decided from
measured shuffle sizes at runtime.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
from collections.abc import Iterator

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_LOCAL_DIR: str | None = None


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "shoptally") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting is required: no other folder is known to be
    shared by driver and executors. A local session (tests), where all of
    them are one process, uses a scratch folder if it is unset.
    """
    global _LOCAL_DIR
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _LOCAL_DIR = _LOCAL_DIR or tempfile.mkdtemp(prefix="shoptally-local-")
    return _LOCAL_DIR


def materialize(df, name: str = "stage", compression: str = "snappy"):
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint
    folder and reading it back.

    Used where one intermediate feeds several branches of a plan. Unlike an
    in-memory cache the written files survive the loss of an executor, and
    the read-back plan carries real file sizes for AQE's join choices.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/materialized/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    out = spark.read.parquet(path)
    out._written_at = path  # for ``release``
    return out


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING: dict[SparkSession, tuple[int, str | None]] = {}
_LOCK = threading.Lock()


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside leave no shuffle files: Spark removes an execution's
    when it ends. Else they stay until the driver happens to collect its
    garbage. The session's own setting holds again afterwards."""
    with _LOCK:
        running, own = _CLEANING.get(spark, (0, None))
        if not running:
            own = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _CLEANING[spark] = running + 1, own
    try:
        yield
    finally:
        with _LOCK:
            running, own = _CLEANING.pop(spark)
            if running > 1:
                _CLEANING[spark] = running - 1, own
            elif own is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, own)


def materialize_lean(df, name: str = "stage"):
    """``materialize`` for long chains of steps over large tables: it takes less
    disk. Files are compressed harder, the shuffle files of the write go when
    it ends, and ``release`` deletes the files once no step reads them."""
    with _shuffles_removed(df.sparkSession):
        return materialize(df, name, "zstd")


def release(*frames) -> None:
    """Delete the files of materialized frames that no later step reads. Frames
    that were not materialized are left alone."""
    for df in frames:
        path = vars(df).pop("_written_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
