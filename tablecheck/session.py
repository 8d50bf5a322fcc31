"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T, R = TypeVar("T"), TypeVar("R")
JOBS_AT_ONCE = 4
# Paths that this process has handed out and not released.
_scratch: list[str] = []

# Settings that may be changed on a running session. Memory and cores belong to the cluster,
# so they are left alone.
PARTITION_BYTES = 128 * 1024 * 1024
MIN_PARTITIONS = 10
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.debug.maxToStringFields": "250",
}


def configure(
    spark: SparkSession, overrides: dict[str, str] | None = None, input_bytes: int | None = None
) -> SparkSession:
    """Set the runtime SQL settings on the caller's session and return it.

    With ``input_bytes``, the size of what will be shuffled, there are as many shuffle
    partitions as make PARTITION_BYTES each; adaptive execution joins those that stay small,
    but cannot split them all.
    """
    settings = {**RUNTIME_SETTINGS, **(overrides or {})}
    if input_bytes is not None:
        partitions = max(MIN_PARTITIONS, -(-input_bytes // PARTITION_BYTES))
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for name, value in settings.items():
        spark.conf.set(name, value)
    return spark


def in_parallel(work: Callable[[str, T], R], items: Mapping[str, T]) -> dict[str, R]:
    """``work(name, item)`` for each item, a few jobs at a time so that small ones overlap."""
    # Job groups and cancels of the caller's thread reach these threads.
    session = SparkSession.getActiveSession()
    run = inheritable_thread_target(session)(lambda pair: work(*pair))
    with ThreadPoolExecutor(max_workers=JOBS_AT_ONCE) as pool:
        done = pool.map(run, items.items())
        return dict(zip(items, done))


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path in the session's checkpoint folder: the one that the caller set on the
    context, or that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder; on a cluster
    a machine-local folder would not be seen by the other executors.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="tablecheck-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tablecheck/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the scratch tables of this process, from the ``since``-th on; returns how many.

    Frames that read them can no longer be used, so call it when a run's results are written.
    """
    paths, _scratch[since:] = _scratch[since:], []
    for path in paths:
        remove(spark, path)
    return len(paths)


def _file(spark: SparkSession, path: str):
    """The path and its file system, as Spark sees them."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, files = _file(spark, path)
    return files.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    found, files = _file(spark, path)
    files.delete(found, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    found, files = _file(spark, path)
    target = _file(spark, to)[0]
    files.mkdirs(target.getParent())
    if not files.rename(found, target):
        raise OSError(f"{path} could not be moved to {to}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what the runs inside have written to the scratch folder."""
    since = len(_scratch)
    try:
        yield
    finally:
        release(spark, since)


def stored(df: DataFrame, label: str = "table") -> str:
    """Write ``df`` once to the shared scratch folder; its path there."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return path


def pin(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts lineage: later stages re-read files instead of re-running joins, and lost
    executors cost nothing that was already written.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, label))
