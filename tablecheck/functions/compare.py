"""How two columns of possibly different types are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATOMIC = (
    T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType,
    T.TimestampNTZType, T.BinaryType,
)
# Decimal digits a type without fraction can hold.
_DIGITS = {"boolean": 1, "tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def common_type(name: str, left: T.DataType, right: T.DataType) -> T.DataType:
    """The type both sides are brought to; raises ``ValueError`` if there is none."""
    for dtype in (left, right):
        if not isinstance(dtype, _ATOMIC):
            raise ValueError(f"column {name}: {dtype.simpleString()} cannot be compared")
    if isinstance(left, T.StringType) or isinstance(right, T.StringType):
        return T.StringType()
    if left == right and not isinstance(left, T.NumericType):
        return left
    if all(isinstance(t, (T.NumericType, T.BooleanType)) for t in (left, right)):
        return _numeric(left, right)
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(left, dates) and isinstance(right, dates):
        both = {type(left), type(right)}
        return T.TimestampType() if T.TimestampType in both else T.TimestampNTZType()
    raise ValueError(
        f"column {name}: {left.simpleString()} and {right.simpleString()} have no common type"
    )


def _numeric(left: T.DataType, right: T.DataType) -> T.DataType:
    floats = (T.FloatType, T.DoubleType)
    if isinstance(left, floats) or isinstance(right, floats):
        return T.DoubleType()
    if not isinstance(left, T.DecimalType) and not isinstance(right, T.DecimalType):
        return T.LongType()
    sizes = [
        (t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType)
        else (_DIGITS[t.simpleString()], 0)
        for t in (left, right)
    ]
    whole, scale = (max(part) for part in zip(*sizes))
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()


def castable_to_double(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.StringType, T.BooleanType, T.TimestampType))


def _within(left: Column, right: Column, tolerance: float) -> Column:
    # Two strict bounds instead of abs(): the smallest long has no absolute value.
    # A difference that does not fit its type is null, and null is not "within".
    difference = F.try_subtract(left, right)
    return (difference < F.lit(tolerance)) & (difference > F.lit(-tolerance))


# What reads as a number in text of unknown kind: neither codes that begin with 0 or end in a
# type letter nor an exponent without a point, such as 0012, 12d and 1e3.
STRICT_NUMBER = r"^[+-]?(0|[1-9][0-9]*)([.][0-9]+([eE][+-]?[0-9]+)?)?$"
# What reads as a number in text that holds numbers.
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
WHOLE = r"^\s*[+-]?[0-9]+\s*$"


def _texts_within(left: Column, right: Column, tolerance: float, pattern: str) -> Column:
    """Texts that both match ``pattern``, as decimals while they fit, else as doubles."""

    def apart(dtype: str) -> Column:
        return _within(left.try_cast(dtype), right.try_cast(dtype), tolerance)

    whole = left.rlike(WHOLE) & right.rlike(WHOLE)
    fits = left.try_cast("decimal(38,18)").isNotNull() & right.try_cast("decimal(38,18)").isNotNull()
    long = left.try_cast("decimal(38,0)").isNotNull() & right.try_cast("decimal(38,0)").isNotNull()
    close = (
        F.when(whole & long, apart("decimal(38,0)")).when(fits, apart("decimal(38,18)"))
        .otherwise(apart("double"))
    )
    return left.rlike(pattern) & right.rlike(pattern) & close


def approx_equal(
    left: Column, right: Column, dtype: T.DataType, tolerance: float,
    text_numbers: str | None = None,
) -> Column:
    """True when both are null, both are the same value, or numbers closer than ``tolerance``.

    Longs and decimals are subtracted in their own type, so large values keep every
    digit. Text is compared as a number where both sides match ``text_numbers``,
    STRICT_NUMBER or NUMBER.
    """
    same = left.eqNullSafe(right)
    if isinstance(dtype, T.NumericType):
        close = _within(left, right, tolerance)
    elif text_numbers is not None and isinstance(dtype, T.StringType):
        close = _texts_within(left, right, tolerance, text_numbers)
    else:
        return same
    return F.coalesce(same | close, F.lit(False))
