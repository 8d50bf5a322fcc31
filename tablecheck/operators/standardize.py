"""Names, dates and date ranges brought to one form before tables are compared."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions.columns import column, date_literal, parse_date, quoted, render_date


def upper_names(df: DataFrame) -> DataFrame:
    """Upper-case every column name; names that collide are an error."""
    names = [name.upper() for name in df.columns]
    twice = sorted(name for name, n in Counter(names).items() if n > 1)
    if twice:
        raise ValueError(f"column names collide in upper case: {twice}")
    return df.toDF(*names)


def standardize_dates(df: DataFrame, date_cols: Iterable[str]) -> DataFrame:
    """Turn the named columns into dates, in one projection."""
    wanted = set(date_cols)
    missing = wanted - set(df.columns)
    if missing:
        raise ValueError(f"no such date columns: {sorted(missing)}")
    if not wanted:
        return df
    return df.select(
        *[
            parse_date(column(f.name), f.dataType).alias(f.name)
            if f.name in wanted else column(f.name)
            for f in df.schema
        ]
    )


def unparsed_dates(df: DataFrame, date_cols: Iterable[str]) -> DataFrame:
    """``(column, unparsed)``: values that standardising turns into null, in one pass."""
    names = list(date_cols)
    counts = [
        F.count_if(
            column(n).isNotNull() & parse_date(column(n), df.schema[n].dataType).isNull()
        ).alias(n)
        for n in names
    ]
    return counted(df.agg(*counts), names, "unparsed")


def counted(one_row: DataFrame, names: Iterable[str], value_name: str) -> DataFrame:
    """A one-row frame of counts as ``(column, <value_name>)`` rows."""
    return one_row.unpivot([], [quoted(n) for n in names], "column", value_name)


def in_date_range(
    df: DataFrame, date_col: str, start: str, end: str, *, as_date: bool = False
) -> DataFrame:
    """Rows whose date is known and lies in ``[start, end]``.

    On a date or timestamp column the filter is a plain comparison, which Spark pushes
    to the scan; text is parsed first. A timestamp is compared with the first moment of
    ``end``, or with all of that day if it counts ``as_date``.
    """
    dtype = df.schema[date_col].dataType
    value, first, last = column(date_col), date_literal(start), date_literal(end)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) and as_date:
        return df.filter((value >= first) & (value < F.date_add(last, 1)))
    if not isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = parse_date(value, dtype)
    return df.filter(value.isNotNull() & value.between(first, last))


def latest_date(df: DataFrame, date_col: str) -> DataFrame:
    """One row ``(latest)``: the highest date of a column, as ISO text."""
    value = parse_date(column(date_col), df.schema[date_col].dataType)
    return df.agg(render_date(F.max(value)).alias("latest"))
