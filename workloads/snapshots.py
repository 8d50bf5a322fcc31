"""Second versions of the given tables, derived from them by expressions.

Every row of the table is in both versions; some rows change their key, so they are
one-sided, and some change a value.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", iso("o_orderdate"))


def changed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return orders(spark, sf_dir).select(
        F.when(key % 10 == 4, -key).otherwise(key).alias("o_orderkey"),
        "o_custkey",
        F.when(key % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 7 == 0, price + 0.01)
        .when(key % 11 == 0, price + 0.00001)
        .otherwise(price).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )


def old_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer numbers as doubles: reports hold nulls, which some readers of integers
    cannot show."""
    return orders(spark, sf_dir).withColumn("o_custkey", F.col("o_custkey").cast("double"))


def new_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = changed_orders(spark, sf_dir)
    return changed.withColumn("o_custkey", F.col("o_custkey").cast("double"))


def with_null_keys(df: DataFrame) -> DataFrame:
    """A third of the rows lose their key; ``ref`` still tells them apart."""
    key = F.col("o_orderkey")
    nulled = F.when(key % 3 != 1, key).alias("o_orderkey")
    return df.select(nulled, key.alias("ref"), *[c for c in df.columns if c != "o_orderkey"])


def old_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("double").alias("l_partkey"),
        "l_quantity", "l_extendedprice", "l_returnflag",
    )


def new_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, price = F.col("l_partkey"), F.col("l_extendedprice")
    return old_lines(spark, sf_dir).withColumn(
        "l_extendedprice",
        F.when(part % 5 == 0, price + 1.5).when(part % 7 == 0, price + 0.00001).otherwise(price),
    ).withColumn(
        "l_linenumber",
        F.when(part % 11 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber")),
    )


def old_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth event takes the next one's number, so a few keys repeat."""
    number = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(number % 100 == 0, number + 1).otherwise(number).alias("event_id"),
        "user_id", "event_type", "value",
    )


def new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, value = F.col("user_id"), F.col("value")
    return old_events(spark, sf_dir).withColumn(
        "value", F.when(user % 3 == 0, value + 0.00001).when(user % 7 == 0, value + 2)
        .otherwise(value),
    )


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def contract_json(df: DataFrame, types: dict[str, str], nullable: set[str]) -> dict:
    return {c: {"type": types[c], "nullable": c in nullable} for c in df.columns}


def write_contract(spark: SparkSession, contract: dict, path: str) -> None:
    document = {name: {"type_map": columns} for name, columns in contract.items()}
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(path)


ORDER_TYPES = {
    "o_orderkey": "int64", "o_custkey": "Int64", "o_orderstatus": "string",
    "o_totalprice": "float64", "o_orderdate": "datetime64", "o_orderpriority": "object",
}
CUSTOMER_TYPES = {
    "c_custkey": "int64", "c_name": "string", "c_nationkey": "int32", "c_acctbal": "float64",
    "c_mktsegment": "string",
}
NATION_TYPES = {"n_nationkey": "int64", "n_name": "string", "n_regionkey": "Int32"}


def pack_reader(name: str):
    # Nested, so executors need not have this package.
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"{name}.csv", batch.to_csv(sep=";", index=False))
                archive.writestr("readme.txt", "not a table")
            yield pd.DataFrame({"content": [buffer.getvalue()]})

    return pack


def zipped(df: DataFrame, name: str) -> DataFrame:
    """``(content)``: the rows as delimited files in zip archives, one per batch."""
    return df.mapInPandas(pack_reader(name), "content binary")
