"""Column functions (built-in Spark expressions only, no Python UDFs)."""

from .paths import absolute_path, file_key, join_path, relative_path, split_path, user_space_flag
from .text import code_points, prefix_match, token_starts
from .kinds import highlight_kind, setter_name, singleton_label, symbol_kind

__all__ = [
    "absolute_path", "file_key", "join_path", "relative_path", "split_path", "user_space_flag",
    "code_points", "prefix_match", "token_starts",
    "highlight_kind", "setter_name", "singleton_label", "symbol_kind",
]
