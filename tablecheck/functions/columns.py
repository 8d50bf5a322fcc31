"""Column helpers: safe names and dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name as an identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def parse_date(value: Column, dtype: T.DataType) -> Column:
    """Read a date out of text, numbers, dates or timestamps.

    Text may be ``yyyyMMdd``, ``yyyy-MM-dd`` or a timestamp that begins with either;
    what cannot be read becomes null. A date column is passed through untouched so that
    filters on it still reach the scan.
    """
    if isinstance(dtype, T.DateType):
        return value
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return value.cast("date")
    digits = F.replace(value.cast("string"), F.lit("-"), F.lit(""))
    return F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd")


def render_date(value: Column) -> Column:
    """A date as ISO text."""
    return F.date_format(value, "yyyy-MM-dd")


def date_literal(text: str | dt.date) -> Column:
    """A date bound; text that is not an ISO date fails here, before any job runs."""
    return F.lit(text if isinstance(text, dt.date) else dt.date.fromisoformat(text))
