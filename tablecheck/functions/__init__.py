from tablecheck.functions.columns import column, parse_date, quoted, render_date
from tablecheck.functions.compare import approx_equal, common_type
from tablecheck.functions.tokens import (
    TokenStyle,
    found_terms,
    token_of,
    tokenize,
)

__all__ = [
    "TokenStyle", "approx_equal", "column", "common_type", "found_terms", "parse_date",
    "quoted", "render_date", "token_of", "tokenize",
]
