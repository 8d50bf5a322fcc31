"""Whole checks in one call: two frames, or two paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablecheck.operators.reconcile import Reconciliation, reconcile
from tablecheck.operators.sampling import Sample
from tablecheck.sources.tables import format_of, read_table


def reconcile_files(
    spark: SparkSession,
    left_path: str,
    right_path: str,
    keys: Sequence[str],
    *,
    sep: str = ";",
    header: bool | None = None,
    infer_schema: bool | None = None,
    numeric_cols: Sequence[str] | None = None,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    reader_options: Mapping[str, object] | None = None,
    **options,
) -> Reconciliation:
    """``reconcile`` on two paths; each path's ending decides its format unless ``fmt`` does.

    Delimited columns read without inference or ``schema`` are text, so their numbers are
    compared within the tolerance unless ``numeric_cols`` says which ones. ``reader_options``
    (``multiLine``, ``escape``, ``encoding``, ...) go to Spark's reader.
    """
    paths = (left_path, right_path)
    left, right = (
        read_table(
            spark, path, fmt=fmt, sep=sep, header=header, infer_schema=infer_schema,
            schema=schema, **(reader_options or {}),
        )
        for path in paths
    )
    untyped = not infer_schema and schema is None and "csv" in [fmt or format_of(p) for p in paths]
    if numeric_cols is None:
        numeric_cols = ("*",) if untyped else ()
    return reconcile(left, right, keys, numeric_cols=numeric_cols, **options)


def _date_range(column: str | None, start: str | None, end: str | None):
    return (column, start, end) if column and start and end else None


def _print_counts(result: Reconciliation, nulls: bool, mismatches: bool) -> None:
    if nulls:
        for row in result.null_counts.collect():
            print(f"null keys in {row['column']}{row['side']}: {row['null_count']}")
    if mismatches:
        for row in result.mismatch_counts.collect():
            print(f"{row['column']}: {row['mismatches']}")


def assert_dataframes_approx_equal(
    df1: DataFrame, df2: DataFrame, suffixes: Sequence[str] = ("_OLD", "_NEW"),
    count_nulls: bool = False, keep_equal: bool = False,
    index_columns: Sequence[str] | None = None, show_detailed_regression: bool = False,
    output_path_name: str = "", start_date: str | None = None, end_date: str | None = None,
    ref_date_column: str | None = None, date_columns: Sequence[str] | None = None,
    abs_tolerance: float = 1e-4, **options,
) -> DataFrame:
    """Compare two frames, write a CSV report if rows are left, and return those rows.

    Frames of different shape raise ``ValueError``.
    """
    result = reconcile(
        df1, df2, index_columns or (), suffixes=suffixes, keep_equal=keep_equal,
        date_cols=date_columns or (), abs_tol=abs_tolerance,
        date_range=_date_range(ref_date_column, start_date, end_date), **options,
    ).pin()
    _print_counts(result, count_nulls, show_detailed_regression)
    if output_path_name and result.write_report(output_path_name):
        # With keep_equal the report has rows where nothing differs.
        differ = not keep_equal or not result.mismatches.isEmpty()
        print(f"the tables {'differ' if differ else 'agree'}, see {output_path_name}")
    return result.rows


def assert_files_approx_equal(
    spark: SparkSession, df1_path: str, df2_path: str, sep: str = ";",
    header: bool | None = None, infer_schema: bool | None = None, sample_fraction: float = 0.10,
    sample_by_col: str | None = None, count_nulls: bool = False,
    suffixes: Sequence[str] = ("_OLD", "_NEW"), keep_equal: bool = False,
    index_columns: Sequence[str] | None = None, detailed_regression: bool = False,
    start_date: str | None = None, end_date: str | None = None,
    ref_date_column: str | None = None, date_columns: Sequence[str] | None = None,
    output_csv_path: str | None = None, abs_tolerance: float = 1e-4, **options,
) -> None:
    """Assert that two tables on disk agree: no mismatching row, equal counts and schemas.

    A sample is taken only when ``sample_by_col`` names a key column.
    """
    keys = list(index_columns or ())
    sample = None
    if sample_by_col and sample_fraction:
        if sample_by_col.upper() not in [k.upper() for k in keys]:
            raise ValueError(f"sample_by_col {sample_by_col} is not a key column")
        sample = Sample(sample_fraction)
    result = reconcile_files(
        spark, df1_path, df2_path, keys, sep=sep, header=header, infer_schema=infer_schema,
        suffixes=suffixes, keep_equal=keep_equal, date_cols=date_columns or (), sample=sample,
        abs_tol=abs_tolerance, date_range=_date_range(ref_date_column, start_date, end_date),
        **options,
    ).pin()
    _print_counts(result, count_nulls, detailed_regression)
    if output_csv_path and result.write_report(output_csv_path, stamped=True):
        result.rows.show()
    # Text columns against typed ones differ in type by nature.
    alike = format_of(df1_path) == format_of(df2_path) or bool(infer_schema)
    totals = result.assert_equal(check_schema=alike)
    print(f"tables are identical, {totals['seconds']} seconds")
