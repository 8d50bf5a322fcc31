"""Applying a table contract: types, nullability, and the ingest job."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions.columns import column, render_date
from tablecheck.session import exists, in_parallel, move, remove
from tablecheck.sinks.reports import write_tables
from tablecheck.sources.contracts import UNEVEN, ColumnRule, Contract, table_name
from tablecheck.sources.tables import read_table

# Contract type names and what they mean here.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "object": T.StringType(),
    "int64": T.LongType(),
    "Int64": T.LongType(),
    "int32": T.IntegerType(),
    "Int32": T.IntegerType(),
    "float64": T.DoubleType(),
    "Float64": T.DoubleType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "datetime64": T.DateType(),
}

# Cell texts that mean "no value" in delimited files.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Working column: which cells of a row did not read as their type.
UNREAD = "_unread_cells"
CORRUPT = "_corrupt_record"
HINT = " of records differ in number from the header (multi_line=True allows line ends in cells)"


def spark_type(rule: ColumnRule) -> T.DataType:
    try:
        return TYPES[rule.type]
    except KeyError:
        raise ValueError(f"column {rule.name}: unknown contract type {rule.type!r}") from None


def contract_schema(rules: tuple[ColumnRule, ...]) -> T.StructType:
    return T.StructType([T.StructField(r.name, spark_type(r), r.nullable) for r in rules])


def _cell(name: str) -> Column:
    value = column(name)
    return F.when(~value.isin(*NULL_TEXTS), value)


def _typed(rule: ColumnRule) -> Column:
    """A cell that has been through ``_cell``, in its type."""
    cell, dtype = column(rule.name), spark_type(rule)
    if isinstance(dtype, T.StringType):
        return cell
    if isinstance(dtype, T.DateType):
        return F.try_to_date(cell, "yyyy-MM-dd")
    if isinstance(dtype, T.BooleanType):
        word = F.lower(cell)
        return F.when(word == "true", True).when(word == "false", False)
    return cell.try_cast(dtype)


def checked(raw: DataFrame, table: str, rules: tuple[ColumnRule, ...]) -> DataFrame:
    """Text columns brought to their contract types, other columns left as text.

    Cells that do not read as their type become null, and the names of their columns go
    into the array ``UNREAD``.
    """
    missing = [r.name for r in rules if r.name not in raw.columns]
    if missing:
        raise ValueError(f"table {table}: columns missing from the file: {missing}")
    kept = [n for n in raw.columns if n != UNEVEN]
    uneven = [UNEVEN] if UNEVEN in raw.columns else []
    parsed = {
        r.name: (f"_typed_{i}", r) for i, r in enumerate(rules)
        if not isinstance(spark_type(r), T.StringType)
    }
    # One step after the other, so that each cell is cleaned once and parsed once.
    cells = raw.select(*[_cell(n).alias(n) for n in kept], *uneven)
    typed = cells.select("*", *[_typed(r).alias(alias) for alias, r in parsed.values()])
    unread = [
        F.when(column(n).isNotNull() & F.col(alias).isNull(), F.lit(n))
        for n, (alias, _) in parsed.items()
    ]
    names = F.array_compact(F.array(*unread)) if unread else F.array().cast("array<string>")
    columns = [F.col(parsed[n][0]).alias(n) if n in parsed else column(n) for n in kept]
    return typed.select(*columns, *uneven, names.alias(UNREAD))


def conform(
    raw: DataFrame, table: str, rules: tuple[ColumnRule, ...], *, dates_as_text: bool = True
) -> DataFrame:
    """``raw`` with contract types; cells that do not read as their type are null."""
    return _shown(checked(raw, table, rules), rules, dates_as_text)


def _shown(typed: DataFrame, rules: tuple[ColumnRule, ...], dates_as_text: bool) -> DataFrame:
    dates = {r.name for r in rules if isinstance(spark_type(r), T.DateType)}
    return typed.select(
        *[
            render_date(column(n)).alias(n) if dates_as_text and n in dates else column(n)
            for n in typed.columns if n not in (UNREAD, UNEVEN)
        ]
    )


def _checks(typed: DataFrame, rules: tuple[ColumnRule, ...]) -> dict[str, tuple]:
    """By name of the count: the column, the rule, and which rows break it."""
    checks = {}
    for i, rule in enumerate(rules):
        unread = F.array_contains(UNREAD, rule.name)
        if not rule.nullable:
            checks[f"n{i}"] = (rule.name, "not_null", column(rule.name).isNull() & ~unread)
        if not isinstance(spark_type(rule), T.StringType):
            checks[f"t{i}"] = (rule.name, "type", unread)
    if UNEVEN in typed.columns:
        checks["uneven"] = ("(record)", "cells", F.col(UNEVEN))
    return checks


def _table_violations(typed: DataFrame, table: str, rules: tuple[ColumnRule, ...]) -> DataFrame:
    checks = _checks(typed, rules)
    counts = typed.agg(
        F.count("*").alias("rows"), *[F.count_if(c[2]).alias(n) for n, c in checks.items()]
    )
    found = [
        F.struct(
            F.lit(table).alias("table"), F.lit(name).alias("column"),
            F.lit(rule).alias("rule"), F.col(count).alias("cells"),
        )
        for count, (name, rule, _) in checks.items()
    ]
    rows = "array<struct<table:string,column:string,rule:string,cells:bigint>>"
    return counts.select(F.inline(F.array(*found).cast(rows))).filter("cells > 0")


def violations(raw_tables: Mapping[str, DataFrame], contract: Contract) -> DataFrame:
    """``(table, column, rule, cells)`` wherever text tables break the contract.

    ``not_null`` counts empty cells of columns that may not be null, ``type`` cells that do
    not read as the declared type. ``cells`` counts records that have more or fewer cells
    than the header; a line end inside a quoted cell shows there if the file was read
    without ``multi_line``. One aggregate per table covers all its columns.
    """
    return _all_violations(
        {table: checked(raw, table, contract[table]) for table, raw in raw_tables.items()},
        contract,
    )


def _all_violations(typed: Mapping[str, DataFrame], contract: Contract) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [_table_violations(df, table, contract[table]) for table, df in typed.items()],
    )


def read_raw_tables(
    spark: SparkSession, paths: Mapping[str, str] | list[str], *, sep: str = ";",
    multi_line: bool = False,
) -> dict[str, DataFrame]:
    """Delimited files as text columns named by their headers, and UNEVEN, per table.

    A list of paths names each table by its file name; files of one table must have the same
    header. ``multi_line`` allows line ends inside quoted cells, at the price of one task per
    file.
    """
    if not isinstance(paths, Mapping):
        paths = {table_name(path.rstrip("/")): path for path in paths}
    options = dict(
        sep=sep, header=True, encoding="UTF-8", multiLine=multi_line, escape='"',
        enforceSchema=False, columnNameOfCorruptRecord=CORRUPT,
    )

    def read(table: str, path: str) -> DataFrame:
        names = spark.read.csv(path, **options).columns
        fields = [T.StructField(n, T.StringType()) for n in [*names, CORRUPT]]
        # Without pruning a record is judged by all its cells, whichever are used.
        reader = spark.read.schema(T.StructType(fields)).option("columnPruning", False)
        rows = reader.csv(path, **options)
        # Spark refuses to read the noted record alone, so a real column is looked at too.
        anything = F.coalesce(F.octet_length(column(names[0])), F.lit(0)) >= 0
        uneven = (F.col(CORRUPT).isNotNull() & anything).alias(UNEVEN)
        return rows.select(*[column(n) for n in names], uneven)

    return in_parallel(read, paths)


def ingest(
    raw_tables: Mapping[str, DataFrame], contract: Contract, out: str, *, fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """Check text tables against the contract and write them typed, one folder each.

    The text is parsed and written once, beside its final place; the job that writes a table
    counts what breaks the contract. The folders are moved to ``out`` when no table does.
    Otherwise nothing stays, and the error lists every offending column.
    """
    unknown = sorted(set(raw_tables) - set(contract))
    if unknown:
        raise ValueError(f"tables without a contract: {unknown}")
    spark = next(iter(raw_tables.values())).sparkSession if raw_tables else None
    if spark is None:
        return {}
    staging = f"{out.rstrip('/')}_staging-{uuid.uuid4().hex}"
    taken = [t for t in raw_tables if exists(spark, f"{out.rstrip('/')}/{t}")]
    if taken:
        raise FileExistsError(f"tables exist already in {out}: {taken}")
    typed = {t: checked(raw, t, contract[t]) for t, raw in raw_tables.items()}
    rules = {t: _checks(df, contract[t]) for t, df in typed.items()}
    seen = {t: Observation() for t in typed}
    shown = {
        t: _shown(
            df.observe(seen[t], F.count("*").alias("rows"), *[
                F.count_if(broken).alias(name) for name, (_, _, broken) in rules[t].items()
            ]),
            contract[t], True,
        )
        for t, df in typed.items()
    }
    try:
        write_tables(shown, staging, fmt=fmt)
        broken = [
            f"{t}.{name}: {cells} {rule}" + (HINT if rule == "cells" else "")
            for t in typed for count, (name, rule, _) in rules[t].items()
            if (cells := seen[t].get[count])
        ]
        if broken:
            raise ValueError(f"contract violations: {', '.join(broken)}")
        for t in typed:
            move(spark, f"{staging}/{t}", f"{out.rstrip('/')}/{t}")
    finally:
        remove(spark, staging)
    return {
        t: read_table(spark, f"{out.rstrip('/')}/{t}", fmt=fmt, sep=",", header=True, schema=df.schema)
        for t, df in shown.items()
    }
