"""Path functions (FN-1 .. FN-4, FN-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_key(rel_path) -> Column:
    """FN-1: opaque key of a file, equality only: SHA-256 hex of the relative path."""
    return F.sha2(_c(rel_path), 256)


def relative_path(path, root) -> Column:
    """FN-2: strip the root when the path starts with it, else keep the path."""
    path = _c(path)
    root = F.lit(root) if isinstance(root, str) else root
    rest = path.substr(F.length(root) + 1, F.lit(2**31 - 1))
    return F.when(F.startswith(path, root), rest).otherwise(path)


def split_path(path) -> Column:
    """FN-3: split on '/' and drop empty parts."""
    return F.filter(F.split(_c(path), "/", -1), lambda p: p != F.lit(""))


def join_path(parts) -> Column:
    """FN-3: join parts with '/'."""
    return F.array_join(_c(parts), "/")


def absolute_path(parts, user_space, root) -> Column:
    """FN-4: user-space files live under the root, others are rooted at '/'."""
    root = F.lit(root) if isinstance(root, str) else root
    joined = join_path(parts)
    return F.when(_c(user_space), F.concat(root, F.lit("/"), joined)) \
        .otherwise(F.concat(F.lit("/"), joined))


def user_space_flag(path, root) -> Column:
    """FN-6: a file is in user space when its path contains the workspace root."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.contains(_c(path), root)
