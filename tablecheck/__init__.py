"""Table reconciliation, contract-checked ingest and reversible text tokens on Spark."""

from tablecheck.checks import (
    assert_dataframes_approx_equal,
    assert_files_approx_equal,
    reconcile_files,
)
from tablecheck.functions import TokenStyle, token_of
from tablecheck.operators import *  # noqa: F403
from tablecheck.operators import __all__ as _operators
from tablecheck.session import configure, release, scratch
from tablecheck.sinks import (
    preview,
    read_report,
    write_dictionary,
    write_partitioned,
    write_rows,
    write_tables,
    write_texts,
)
from tablecheck.sources import (
    read_archives,
    read_contract,
    read_dictionary,
    read_table,
    read_texts,
)

__all__ = [
    *_operators, "TokenStyle", "assert_dataframes_approx_equal", "assert_files_approx_equal",
    "configure", "preview", "read_archives", "read_contract", "read_dictionary", "read_table",
    "read_texts", "reconcile_files", "token_of", "write_dictionary", "write_partitioned", "write_rows",
    "write_tables", "write_texts",
]
