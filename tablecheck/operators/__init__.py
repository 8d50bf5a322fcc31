from tablecheck.operators.contracts import (
    conform,
    contract_schema,
    ingest,
    read_raw_tables,
    violations,
)
from tablecheck.operators.reconcile import (
    Reconciliation,
    duplicate_keys,
    null_key_counts,
    reconcile,
    schema_diff,
)
from tablecheck.operators.sampling import Sample, sample_rows, strata
from tablecheck.operators.standardize import (
    in_date_range,
    latest_date,
    standardize_dates,
    unparsed_dates,
    upper_names,
)
from tablecheck.operators.texts import (
    restore_text,
    round_trip_failures,
    term_dictionary,
    term_presence,
    token_collisions,
    tokenize_text,
)

__all__ = [
    "Reconciliation", "Sample", "conform", "contract_schema", "duplicate_keys", "in_date_range",
    "ingest", "latest_date", "null_key_counts", "read_raw_tables", "reconcile", "restore_text",
    "round_trip_failures", "sample_rows", "schema_diff", "standardize_dates", "strata",
    "term_dictionary", "term_presence", "token_collisions", "tokenize_text", "unparsed_dates",
    "upper_names", "violations",
]
