"""Column expressions."""

from .changes import CHANGE_BITS, change_label, change_mask
from .digests import digest, row_digest
from .formats import format_bytes, format_duration, format_grouped, format_time
from .paths import (
    base_name,
    join_path,
    leading_slashes,
    parent_path,
    path_depth,
    relative_to,
    trim_trailing_slashes,
    within_depth,
)
from .patterns import check_patterns, is_ignored, matches_any

__all__ = [
    "CHANGE_BITS",
    "base_name",
    "change_label",
    "change_mask",
    "check_patterns",
    "digest",
    "format_bytes",
    "format_duration",
    "format_grouped",
    "format_time",
    "is_ignored",
    "join_path",
    "leading_slashes",
    "matches_any",
    "parent_path",
    "path_depth",
    "relative_to",
    "row_digest",
    "trim_trailing_slashes",
    "within_depth",
]
