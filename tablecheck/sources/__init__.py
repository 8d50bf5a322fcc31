from tablecheck.sources.archives import read_archives, unpack, unpacked_tables
from tablecheck.sources.contracts import (
    contract_rows,
    read_contract,
    table_name,
)
from tablecheck.sources.tables import read_dictionary, read_table, read_texts

__all__ = [
    "contract_rows", "read_archives", "read_contract", "read_dictionary", "read_table",
    "read_texts", "table_name", "unpack", "unpacked_tables",
]
