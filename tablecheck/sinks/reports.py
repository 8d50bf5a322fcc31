"""Table sinks. Rows are written by the tasks that hold them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession

from tablecheck.functions.columns import column
from tablecheck.session import in_parallel

# How reports are written, and so read: quotes in values are doubled.
CSV = {"header": True, "escape": '"'}


def write_rows(
    df: DataFrame, path: str, *, fmt: str = "csv", single_file: bool = False,
    stamped: bool = False, skip_empty: bool = True, ordered_by: Sequence[Column] = (),
) -> bool:
    """Write ``df``; true when something was written. An empty frame is not written unless
    ``skip_empty`` is off, which saves looking.

    A plain path is overwritten. With ``stamped`` the run time is added to the path and an
    existing folder is an error. ``single_file`` sends the rows, once computed, to one
    task: for reports known to be small. ``ordered_by`` sorts them, in a single file too.
    """
    if skip_empty and df.isEmpty():
        return False
    if stamped:
        path = f"{path.removesuffix('.csv')}_{datetime.now():%Y-%m-%d_%H-%M-%S}"
    if single_file:
        df = df.repartition(1)
        if ordered_by:
            df = df.sortWithinPartitions(*ordered_by)  # rows arrive from tasks in any order
    elif ordered_by:
        df = df.orderBy(*ordered_by)
    writer = df.write.mode("errorifexists" if stamped else "overwrite").format(fmt)
    (writer.options(**CSV) if fmt == "csv" else writer).save(path)
    return True


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report that ``write_rows`` wrote as CSV, as text, line ends in values included."""
    return spark.read.csv(path, multiLine=True, **CSV)


def write_tables(
    tables: dict[str, DataFrame], path: str, *, fmt: str = "parquet", mode: str = "errorifexists"
) -> dict[str, str]:
    """One folder per table below ``path``; returns where each went."""

    def write(name: str, df: DataFrame) -> str:
        folder = f"{path.rstrip('/')}/{name}"
        writer = df.write.mode(mode).format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(folder)
        return folder

    return in_parallel(write, tables)


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str], *, mode: str = "errorifexists",
    rebalance: bool = True,
) -> None:
    """Parquet folders split by the values of ``by``.

    Rows are first brought together by value, so that not every task writes a file for every
    value; adaptive execution splits a value that holds many rows over several tasks and
    joins small ones. Without ``rebalance`` rows are written where they are.
    """
    if rebalance:
        df = df.hint("rebalance", *[column(c) for c in by])
    df.write.mode(mode).partitionBy(*by).parquet(path)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows, for looking at."""
    return df.limit(n)
