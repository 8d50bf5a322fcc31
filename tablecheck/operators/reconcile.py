"""Reconciling two versions of a table."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions.columns import column
from tablecheck.functions.compare import (
    NUMBER,
    STRICT_NUMBER,
    approx_equal,
    castable_to_double,
    common_type,
)
from tablecheck.operators.sampling import Sample, key_in_sample, sample_rows
from tablecheck.operators.standardize import (
    counted,
    in_date_range,
    standardize_dates,
    upper_names,
)
from tablecheck.plans.copies import Twins, pair_copies, split_by_repetition
from tablecheck.plans.digests import only_changed
from tablecheck.plans.folding import unfold
from tablecheck.plans.joining import fan_out, full_outer
from tablecheck.plans.keys import (
    HOT_ROWS,
    KeyProfile,
    count_unique_keys,
    key_counts,
    null_safe,
    profile_keys,
)
from tablecheck.session import in_parallel, pin
from tablecheck.sinks.reports import write_rows

ON_DUPLICATES = ("pair", "fanout", "error")


@dataclass(frozen=True)
class Layout:
    """Which columns are compared, and in which type. Values are in report order."""

    keys: tuple[str, ...]
    values: tuple[str, ...]
    key_types: tuple[T.DataType, ...]
    value_types: tuple[T.DataType, ...]
    # For text values that are compared as numbers, the pattern of a number.
    text_numbers: dict[str, str]
    suffixes: tuple[str, str]
    tolerance: float
    numeric_only: bool

    @property
    def ks(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.keys))]

    @property
    def vs(self) -> list[str]:
        return [f"v{i}" for i in range(len(self.values))]

    @property
    def flags(self) -> list[str]:
        return [f"f{i}" for i in range(len(self.values))]

    def project(self, df: DataFrame) -> DataFrame:
        """Keys and values under their working names, each in its common type."""

        def typed(name: str, wanted: T.DataType) -> Column:
            given = df.schema[name].dataType
            if given == wanted:
                return column(name)
            if self.numeric_only and not castable_to_double(given):
                return F.lit(None).cast(wanted)
            if self.numeric_only:
                return column(name).try_cast(wanted)
            return column(name).cast(wanted)

        return df.select(
            *[column(n).cast(t).alias(k) for n, t, k in zip(self.keys, self.key_types, self.ks)],
            *[typed(n, t).alias(v) for n, t, v in zip(self.values, self.value_types, self.vs)],
        )

    def compared(self, joined: DataFrame) -> DataFrame:
        """Add one flag per value to ``full_outer`` rows."""
        flags = [
            approx_equal(
                F.col(f"l{i}"), F.col(f"r{i}"), dtype, self.tolerance, self.text_numbers.get(name)
            ).alias(f"f{i}")
            for i, (name, dtype) in enumerate(zip(self.values, self.value_types))
        ]
        return joined.select("*", *flags)

    def differs(self) -> Column:
        return _any_of([F.col("side") != "both", *[~F.col(f) for f in self.flags]])

    def report(self, compared: DataFrame, null_key_text: str | None = None) -> DataFrame:
        """Keys as text, then per value both sides and the flag, then the side."""
        old, new = self.suffixes

        def key_text(k: str) -> Column:
            text = F.col(k).cast("string")
            return text if null_key_text is None else F.coalesce(text, F.lit(null_key_text))

        columns = [key_text(k).alias(name) for k, name in zip(self.ks, self.keys)]
        for i, name in enumerate(self.values):
            columns += [
                F.col(f"l{i}").alias(name + old),
                F.col(f"r{i}").alias(name + new),
                F.col(f"f{i}").alias(f"{name}_COMPARE"),
            ]
        return compared.select(*columns, F.col("side").alias("_SIDE"))

    def check_names(self) -> None:
        names = [*self.keys, "_SIDE"]
        for value in self.values:
            names += [value + self.suffixes[0], value + self.suffixes[1], f"{value}_COMPARE"]
        twice = sorted(n for n, times in Counter(names).items() if times > 1)
        if twice:
            raise ValueError(f"report column names collide: {twice}; choose other suffixes")


def _any_of(conditions: list[Column]) -> Column:
    """A disjunction as a balanced tree, so that wide tables give no deep expression."""
    if len(conditions) == 1:
        return conditions[0]
    middle = len(conditions) // 2
    return _any_of(conditions[:middle]) | _any_of(conditions[middle:])


def _upper(names: Sequence[str] | str | None) -> list[str]:
    return [n.upper() for n in ([names] if isinstance(names, str) else names or ())]


def type_differences(left: DataFrame, right: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """``(column, left_type, right_type)`` wherever name or type differ, upper-cased."""
    sides = [
        {f.name.upper(): f.dataType.simpleString() for f in df.schema} for df in (left, right)
    ]
    names = sorted(sides[0].keys() | sides[1].keys())
    triples = [(n, sides[0].get(n), sides[1].get(n)) for n in names]
    return [t for t in triples if t[1] != t[2]]


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.sparkSession.createDataFrame(
        type_differences(left, right), "column string, left_type string, right_type string"
    )


def null_key_counts(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes=("_OLD", "_NEW")
) -> DataFrame:
    """``(column, side, null_count)``: one pass over the keys of each side."""

    def of(df: DataFrame, side: str) -> DataFrame:
        df = upper_names(df)
        counts = df.agg(*[F.count_if(column(k).isNull()).alias(k) for k in _upper(keys)])
        return counted(counts, _upper(keys), "null_count").withColumn("side", F.lit(side))

    both = of(left, suffixes[0]).unionByName(of(right, suffixes[1]))
    return both.select("column", "side", "null_count")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, copies)`` of every key that occurs more than once."""
    return (
        df.groupBy(*[column(k) for k in keys])
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
    )


@dataclass(frozen=True)
class Reconciliation:
    """The comparison of two tables. Every frame is lazy until an action is called.

    ``joined`` makes the joined rows and the cancelled ones. It is called when rows, counts or
    a verdict are first asked for, as pairing repeated keys writes scratch tables.
    """

    spark: SparkSession
    layout: Layout
    profile: KeyProfile
    prepared: tuple[DataFrame, DataFrame]
    joined: Callable[[], tuple[DataFrame, DataFrame | None]]
    differences: tuple[tuple[str, str | None, str | None], ...]
    keep_equal: bool
    pinned: bool = False

    @cached_property
    def _planned(self) -> tuple[DataFrame, DataFrame | None]:
        return self.joined()

    @property
    def compared(self) -> DataFrame:
        """Joined rows with a flag for each value."""
        return self._planned[0]

    @property
    def cancelled(self) -> DataFrame | None:
        """Rows of repeated keys that are equal on both sides: counted instead of joined."""
        return self._planned[1]

    @property
    def mismatches(self) -> DataFrame:
        """Report rows that differ: any flag false, or present on one side only."""
        return self.layout.report(self._different())

    @property
    def rows(self) -> DataFrame:
        """The report: ``mismatches``, or every compared row with ``keep_equal``."""
        return self.report()

    def report(self, null_key_text: str | None = None) -> DataFrame:
        different = self.compared if self.keep_equal else self._different()
        out = self.layout.report(different, null_key_text)
        if self.keep_equal and self.cancelled is not None:
            out = out.unionByName(self.layout.report(self._equal_copies(), null_key_text))
        return out

    def _different(self) -> DataFrame:
        return self.compared.filter(self.layout.differs())

    def _equal_copies(self) -> DataFrame:
        ks, vs = self.layout.ks, self.layout.vs
        return unfold(self.cancelled, [*ks, *vs], self.profile.max_copies).select(
            *ks,
            *[F.col(v).alias(f"{mark}{v[1:]}") for v in vs for mark in "lr"],
            F.lit("both").alias("side"),
            *[F.lit(True).alias(f) for f in self.layout.flags],
        )

    @property
    def mismatch_counts(self) -> DataFrame:
        """``(column, mismatches)`` for every value column, from one pass."""
        names = [f"{v}_COMPARE" for v in self.layout.values]
        if not names:
            return self.spark.createDataFrame([], "column string, mismatches bigint")
        counts = self.compared.agg(
            *[F.count_if(~F.col(f)).alias(n) for f, n in zip(self.layout.flags, names)]
        )
        return counted(counts, names, "mismatches")

    @property
    def null_counts(self) -> DataFrame:
        """``(column, side, null_count)`` of the keys, as counted up front."""
        rows = [
            (key, side, n)
            for key, counts in zip(self.layout.keys, self.profile.null_counts)
            for side, n in zip(self.layout.suffixes, counts)
        ]
        return self.spark.createDataFrame(rows, "column string, side string, null_count bigint")

    @property
    def duplicate_keys(self) -> DataFrame:
        """``(keys, rows_left, rows_right)`` of keys that occur more than once on a side."""
        counts = key_counts(*self.prepared, self.layout.ks)
        return counts.filter("n_left > 1 OR n_right > 1").select(
            *[column(k).cast("string").alias(n) for k, n in zip(self.layout.ks, self.layout.keys)],
            F.col("n_left").alias("rows_left"),
            F.col("n_right").alias("rows_right"),
        )

    @property
    def schema_diff(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(self.differences), "column string, left_type string, right_type string"
        )

    @property
    def summary(self) -> DataFrame:
        """One row of totals and the verdict, from one pass over the comparison."""
        return self._totals().drop(*self.layout.flags)

    def _totals(self) -> DataFrame:
        """The summary, and beside it the number of false flags per value column."""
        side = F.col("side")
        totals = self.compared.agg(
            F.count_if(side == "left_only").alias("left_only"),
            F.count_if(side == "right_only").alias("right_only"),
            F.count_if(self.layout.differs()).alias("mismatched_rows"),
            *[F.count_if(~F.col(f)).alias(f) for f in self.layout.flags],
        )
        profile = self.profile
        return totals.select(
            F.lit(profile.rows_left).cast("bigint").alias("rows_left"),
            F.lit(profile.rows_right).cast("bigint").alias("rows_right"),
            "left_only", "right_only", "mismatched_rows",
            F.lit(len(self.differences)).cast("bigint").alias("schema_differences"),
            F.when(F.col("mismatched_rows") == 0, "identical").otherwise("different")
            .alias("verdict"),
            *self.layout.flags,
        )

    def pin(self) -> Reconciliation:
        """Run the comparison once and keep its rows in the shared scratch folder.

        Counts, report and verdict then read those rows instead of joining again. Only
        differing rows are written unless equal ones are wanted too.
        """
        if self.pinned:
            return self
        kept = self.compared if self.keep_equal else self._different()
        cancelled = self.cancelled
        if cancelled is not None and self.keep_equal:
            cancelled = pin(cancelled, "equal")
        compared = pin(kept, "compared")
        return replace(self, joined=lambda: (compared, cancelled), pinned=True)

    def write_report(
        self, path: str, *, ordered: bool = False, null_key_text: str | None = None, **options
    ) -> bool:
        """Write the report rows if there are any; true when something was written.

        ``ordered`` sorts them by key, descending. The other options are ``write_rows``'.
        """
        order = [column(k).desc() for k in self.layout.keys] if ordered else []
        return write_rows(self.pin().report(null_key_text), path, ordered_by=order, **options)

    def assert_equal(self, report_path: str | None = None, check_schema: bool = True) -> dict:
        """Raise ``AssertionError`` unless the tables agree; return the run's totals.

        The comparison runs once; totals and report read its differing rows.
        """
        started = time.time()
        result = self.pin()
        totals = result._totals().first().asDict()
        false_flags = [totals.pop(f) for f in self.layout.flags]
        problems = []
        if totals["mismatched_rows"]:
            per_column = dict(zip((f"{v}_COMPARE" for v in self.layout.values), false_flags))
            problems.append(f"{totals['mismatched_rows']} rows differ: {per_column}")
            if report_path is not None:
                result.write_report(report_path, skip_empty=False)
        sampled = (self.profile.sampled_left, self.profile.sampled_right)
        if sampled[0] != sampled[1]:
            problems.append(f"row counts differ: {sampled[0]} and {sampled[1]}")
        if check_schema and self.differences:
            problems.append(f"schemas differ: {list(self.differences)}")
        if problems:
            raise AssertionError("tables are not equal; " + "; ".join(problems))
        totals["seconds"] = round(time.time() - started, 2)
        return totals


def _layout(
    left: DataFrame, right: DataFrame, keys: list[str], value_cols: list[str] | None,
    numeric_cols: list[str], numeric_only: bool, suffixes: Sequence[str], tolerance: float,
) -> Layout:
    left_types, right_types = [{f.name: f.dataType for f in df.schema} for df in (left, right)]
    if not keys:
        raise ValueError("at least one key column is needed")
    shared = [c for c in left_types if c in right_types]
    missing = [c for c in [*keys, *(value_cols or ())] if c not in shared]
    if missing:
        raise ValueError(f"columns missing on one side: {missing}")
    values = sorted(set(shared if value_cols is None else value_cols) - set(keys))
    types = {c: common_type(c, left_types[c], right_types[c]) for c in keys}
    unknown = [c for c in numeric_cols if c != "*" and c not in values]
    if unknown:
        raise ValueError(f"numeric_cols are no value columns: {unknown}")
    text_numbers = {}
    for c in values:
        if numeric_only:
            types[c] = T.DoubleType()
            continue
        types[c] = common_type(c, left_types[c], right_types[c])
        one_is_number = any(isinstance(t[c], T.NumericType) for t in (left_types, right_types))
        if one_is_number or c in numeric_cols:
            text_numbers[c] = NUMBER
        elif "*" in numeric_cols:
            text_numbers[c] = STRICT_NUMBER
    layout = Layout(
        keys=tuple(keys),
        values=tuple(values),
        key_types=tuple(types[c] for c in keys),
        value_types=tuple(types[c] for c in values),
        text_numbers=text_numbers,
        suffixes=(suffixes[0], suffixes[1]),
        tolerance=tolerance,
        numeric_only=numeric_only,
    )
    layout.check_names()
    return layout


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    value_cols: Sequence[str] | None = None,
    numeric_cols: Sequence[str] = (),
    abs_tol: float = 1e-4,
    suffixes: Sequence[str] = ("_OLD", "_NEW"),
    date_cols: Sequence[str] = (),
    date_range: tuple[str, str, str] | None = None,
    sample: Sample | float | None = None,
    keep_equal: bool = False,
    strict_shape: bool = True,
    on_duplicates: str = "pair",
    numeric_only: bool = False,
    max_fanout: float | None = None,
    hot_rows: int = HOT_ROWS,
    unique_keys: bool = False,
    digest_first: bool = False,
    pin_inputs: bool = False,
) -> Reconciliation:
    """Compare two tables row by row on their keys, and column by column on the rest.

    One job counts rows and keys of both sides; the counts gate the comparison
    (``strict_shape``) and choose its plan. Unique keys, the usual case, take one full outer
    join. Repeated keys are paired copy by copy (``"pair"``), joined in all combinations
    (``"fanout"``; with ``max_fanout`` only if that gives no more rows per input row), or refused
    (``"error"``).

    ``numeric_cols`` names text columns whose numbers are compared with the tolerance.
    ``"*"`` stands for all, where only text that can hardly be a code is a number: no leading
    zeros, no type letter, no exponent without a point. ``numeric_only`` turns every value into a double, null if it is no
    number. ``date_range`` is ``(column, start, end)``, both ends included.

    ``unique_keys`` says that no key repeats on either side, as for a primary key. The keys
    are then counted without a shuffle; if it is not so, copies meet in all combinations.
    ``digest_first`` is for wide tables that are expected to agree almost everywhere: rows
    with equal digests of all values are left out before whole rows move, for a second scan.
    It applies to keys that do not repeat, without ``keep_equal``. ``pin_inputs`` writes the compared
    columns of both sides to the scratch folder first: for inputs that are costly to compute
    or differ from run to run, as they are read by more than one job.
    """
    if on_duplicates not in ON_DUPLICATES:
        raise ValueError(f"on_duplicates must be one of {ON_DUPLICATES}")
    if abs_tol < 0:
        raise ValueError("abs_tol must not be negative")
    if isinstance(sample, (int, float)):
        sample = Sample(sample)
    differences = type_differences(left, right)

    def standardized(df: DataFrame) -> DataFrame:
        df, dates = upper_names(df), _upper(date_cols)
        if date_range is not None:
            name, start, end = date_range[0].upper(), date_range[1], date_range[2]
            df = in_date_range(df, name, start, end, as_date=name in dates)
        return standardize_dates(df, dates)

    left, right = standardized(left), standardized(right)
    layout = _layout(
        left, right, _upper(keys), None if value_cols is None else _upper(value_cols),
        _upper(numeric_cols), numeric_only, suffixes, abs_tol,
    )
    one_sided = sorted(set(left.columns) ^ set(right.columns))
    if strict_shape and value_cols is None and one_sided:
        raise ValueError(f"tables have different columns: {one_sided} on one side only")

    ks, vs = layout.ks, layout.vs
    l, r = layout.project(left), layout.project(right)
    if pin_inputs:
        l, r = in_parallel(lambda side, df: pin(df, side), {"left": l, "right": r}).values()
    by_key = sample is not None and sample.method == "key"
    sampled = key_in_sample([F.col(k) for k in ks], sample.fraction) if by_key else None
    count = count_unique_keys if unique_keys else profile_keys
    profile = count(l, r, ks, sampled)
    if strict_shape and profile.rows_left != profile.rows_right:
        raise ValueError(
            "tables have different shapes: "
            f"{profile.rows_left} x {len(left.columns)} {left.columns} and "
            f"{profile.rows_right} x {len(right.columns)} {right.columns}"
        )
    if sample is not None and by_key:
        l, r = sample_rows(l, ks, sample), sample_rows(r, ks, sample)
    elif sample is not None:
        # Drawn once, on one side, and written: both sides keep the keys that were drawn.
        drawn = pin(sample_rows(l, ks, sample).select(*ks).distinct(), "sample")
        drawn = drawn.select(*[F.col(k).alias(f"h_{k}") for k in ks])
        on = null_safe([F.col(k) for k in ks], [F.col(f"h_{k}") for k in ks])
        l, r = l.join(drawn, on, "left_semi"), r.join(drawn, on, "left_semi")
        counted_rows = count(l, r, ks)
        profile = replace(
            counted_rows, rows_left=profile.rows_left, rows_right=profile.rows_right,
            null_counts=profile.null_counts,
        )
    prepared = (l, r)
    numbers = [
        v for v, name, dtype in zip(vs, layout.values, layout.value_types)
        if name in layout.text_numbers or isinstance(dtype, T.NumericType)
    ]
    # Whole numbers closer than 1 are equal.
    whole = tuple(
        v for v, dtype in zip(vs, layout.value_types)
        if abs_tol <= 1 and isinstance(dtype, T.IntegralType)
    )
    twins = Twins(
        abs_tol, tuple(v for v in numbers if v not in whole),
        {v: layout.text_numbers[name] for v, name, dtype in zip(vs, layout.values, layout.value_types)
         if name in layout.text_numbers and isinstance(dtype, T.StringType)},
        whole,
    )
    null_ks = profile.keys_null_on_both_sides(ks)

    def join_unique(l: DataFrame, r: DataFrame) -> DataFrame:
        if digest_first and not keep_equal:
            l, r = only_changed(l, r, ks, vs, null_ks)
        return full_outer(l, r, ks, vs, null_ks)

    if profile.repeated_keys and on_duplicates == "error":
        raise ValueError(
            f"keys repeat: {profile.duplicated_left} keys on the left, "
            f"{profile.duplicated_right} on the right"
        )
    rows = profile.sampled_left + profile.sampled_right
    too_many = max_fanout is not None and profile.pairs > max_fanout * rows
    if profile.repeated_keys and on_duplicates == "fanout" and too_many:
        raise ValueError(
            f"repeated keys would give {profile.pairs} pairs, more than {max_fanout} per "
            "input row; use on_duplicates='pair'"
        )

    def joined() -> tuple[DataFrame, DataFrame | None]:
        cancelled = None
        if not profile.repeated_keys:
            rows = join_unique(l, r)
        elif on_duplicates == "fanout":
            rows = fan_out(l, r, ks, vs, null_ks, profile.max_copies, hot_rows)
        elif profile.few_repeat:
            unique, repeated = split_by_repetition(l, r, ks)
            paired, cancelled = pair_copies(
                *repeated, ks, vs, profile.max_copies, hot_rows, twins, keep_equal
            )
            rows = join_unique(*unique).unionByName(paired)
        else:
            rows, cancelled = pair_copies(
                l, r, ks, vs, profile.max_copies, hot_rows, twins, keep_equal
            )
        return layout.compared(rows), cancelled

    return Reconciliation(
        spark=left.sparkSession,
        layout=layout,
        profile=profile,
        prepared=prepared,
        joined=joined,
        differences=tuple(differences),
        keep_equal=keep_equal,
    )
