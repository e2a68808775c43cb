"""Written intermediates in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}  # by application
#: Whether Spark removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``.

    Where none is named, a local session (one machine, as in tests) gets a temporary folder; on a cluster that is an error,
    since executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="glossa-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(context.applicationId, []).append(path)
    return path


@contextmanager
def exchanges_go(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files behind; they would stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: plans stay short, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    with exchanges_go(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*frames: DataFrame) -> None:
    """Delete the files of settled ``frames`` that nothing will read again."""
    for df in frames:
        path = getattr(df, "_settled_at", None)
        if path:
            _WRITTEN.get(df.sparkSession.sparkContext.applicationId, [path]).remove(path)
            _delete(df.sparkSession, path)
            df._settled_at = None


def sweep(spark: SparkSession) -> int:
    """Delete all intermediates this session has written, once its results are stored elsewhere; returns how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
