from tablecheck.sinks.reports import (
    preview,
    read_report,
    write_partitioned,
    write_rows,
    write_tables,
)
from tablecheck.sinks.texts import write_dictionary, write_texts

__all__ = [
    "preview", "read_report", "write_dictionary", "write_partitioned", "write_rows",
    "write_tables", "write_texts",
]
