"""Table contracts: which columns a table has, of which type, and which may be null."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT_JSON = "map<string,struct<type_map:map<string,struct<type:string,nullable:boolean>>>>"


# Working column of raw tables: the record has not as many cells as the header.
UNEVEN = "_uneven_record"


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str
    nullable: bool


# table name -> its columns
Contract = dict[str, tuple[ColumnRule, ...]]


def table_name(file_name: str) -> str:
    """The part of a file name before its first dot."""
    return file_name.rsplit("/", 1)[-1].split(".", 1)[0]


def table_of(file_name: str) -> Column:
    """``table_name`` of a column."""
    return F.substring_index(F.substring_index(file_name, "/", -1), ".", 1)


def contract_rows(texts: DataFrame) -> DataFrame:
    """``(table, column, type, nullable)`` from a frame with a JSON ``value`` column."""
    tables = texts.select(F.explode(F.from_json("value", CONTRACT_JSON)).alias("table", "spec"))
    columns = tables.select("table", F.explode("spec.type_map").alias("column", "rule"))
    return columns.select("table", "column", "rule.type", "rule.nullable")


def _last_member_reader():
    # Nested, so executors need not have this package.
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    texts.append(archive.read(archive.namelist()[-1]).decode("utf-8"))
            yield pd.DataFrame({"value": texts})

    return read


def read_contract(spark: SparkSession, path: str) -> Contract:
    """Load a contract from JSON, or from the last member of a zip.

    A contract is metadata, a few rows per table, so it ends up on the driver.
    """
    if path.endswith(".zip"):
        files = spark.read.format("binaryFile").load(path).select("content")
        texts = files.mapInPandas(_last_member_reader(), "value string")
    else:
        texts = spark.read.text(path, wholetext=True)
    contract: dict[str, list[ColumnRule]] = {}
    for row in contract_rows(texts).collect():
        rules = contract.setdefault(row["table"], [])
        # A column is taken to be nullable only where the contract says so.
        rules.append(ColumnRule(row["column"], row["type"], bool(row["nullable"])))
    if not contract:
        raise ValueError(f"no tables in contract {path}")
    return {table: tuple(rules) for table, rules in contract.items()}
