"""Delimited files packed in zip archives."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.session import scratch_path
from tablecheck.sources.contracts import UNEVEN, table_of

# Records handed to Spark at a time, so a large member is never held whole.
BATCH = 10_000


def _record_reader(sep: str, batch_size: int):
    # Everything the tasks run is nested here, so executors need not have this package.
    def rows(member: str, records: list[list[str]], is_header: bool) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array([member] * n), pa.array([is_header] * n), pa.array(records, pa.list_(pa.string()))],
            names=["member", "is_header", "cells"],
        )

    def members(archive: zipfile.ZipFile) -> Iterator[pa.RecordBatch]:
        for member in archive.namelist():
            if not member.endswith(".csv"):
                continue
            with archive.open(member) as raw:
                # A CSV reader, not a split on newlines: quoted cells may hold line ends.
                text = io.TextIOWrapper(raw, "utf-8-sig", newline="")
                reader = csv.reader(text, delimiter=sep)
                header = next(reader, None)
                if header is not None:
                    yield rows(member, [header], True)
                batch: list[list[str]] = []
                for record in reader:
                    if record:
                        batch.append(record)
                    if len(batch) == batch_size:
                        yield rows(member, batch, False)
                        batch = []
                if batch:
                    yield rows(member, batch, False)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)  # a cell may be as long as Spark's strings
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    yield from members(archive)

    return read


def unpack(archives: DataFrame, sep: str = ";") -> DataFrame:
    """``(table, is_header, cells)`` for every record of the ``.csv`` members.

    ``archives`` has a binary ``content`` column. Each archive is read by one task, as zip
    allows no other way, and record by record.
    """
    records = archives.select("content").mapInArrow(
        _record_reader(sep, BATCH), "member string, is_header boolean, cells array<string>"
    )
    return records.select(table_of("member").alias("table"), "is_header", "cells")


def unpacked_tables(records: DataFrame) -> dict[str, DataFrame]:
    """One frame of text columns, and UNEVEN, per table from the rows ``unpack`` gives.

    The records are written once to the shared scratch folder, split by table, so that no
    archive is opened again for the next table and later reads are splittable.
    """
    spark = records.sparkSession
    path = scratch_path(spark, "unpacked")
    records.write.partitionBy("table").parquet(path)
    stored = spark.read.schema(records.schema).parquet(path)
    # At most one row per member of an archive comes to the driver.
    headers = stored.filter("is_header").select("table", "cells").distinct()
    layouts: dict[str, list[str]] = {}
    for row in headers.collect():
        if layouts.setdefault(row["table"], row["cells"]) != row["cells"]:
            raise ValueError(f"files of table {row['table']} have different headers")
    return {
        table: stored.filter((F.col("table") == table) & ~F.col("is_header")).select(
            *[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(header)],
            (F.size("cells") != len(header)).alias(UNEVEN),
        )
        for table, header in sorted(layouts.items())
    }


def read_archives(spark: SparkSession, path: str, sep: str = ";") -> dict[str, DataFrame]:
    """The delimited tables inside the zip files at ``path``.

    Zip files are read whole by Spark's binary source, so each has less than 2 GiB.
    """
    return unpacked_tables(unpack(spark.read.format("binaryFile").load(path), sep))
