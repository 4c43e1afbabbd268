"""Column expressions and small DataFrame helpers shared by the operators."""

from .keys import SCOPE, is_user_object, join_keys, scope_of, spread
from .ranking import top_k
from .sizes import blocks_to_mb, bytes_to_mb, pretty_size, setting_to_mb, spill_severity
from .text import (
    fingerprint, fixed, grouped, is_wildcard_ilike, is_wildcard_search, query_id, quoted, rounded,
    statement_key,
)

__all__ = [
    "SCOPE", "is_user_object", "join_keys", "scope_of", "spread", "top_k", "blocks_to_mb", "bytes_to_mb",
    "pretty_size", "setting_to_mb", "spill_severity", "fingerprint", "fixed", "grouped", "is_wildcard_ilike",
    "is_wildcard_search", "query_id", "quoted", "rounded",
    "statement_key",
]
