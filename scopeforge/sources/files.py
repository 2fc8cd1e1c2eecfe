"""File sources: tree scans, pruning, lockfiles, roots and their union (SRC-1 .. SRC-8).

Listing and reading happen in the executors (``binaryFile`` source); pruning,
decoding and root resolution are column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_key, relative_path, split_path

# FIXED VALUES: lockfile entry pattern (exactly four leading blanks, "name (version)").
LOCK_PATTERN = r"^\s{4}([a-zA-Z\d\.\-_]+)\s\(([\d\w\.\-_]+)\)"
# Directory names pruned from the workspace, and additionally from other roots.
WORKSPACE_PRUNE = ["node_modules", "tmp", ".git"]
OTHER_PRUNE = WORKSPACE_PRUNE + ["vendor"]
SOURCE_GLOB = "*.rb"


def scan_tree(spark: SparkSession, root: str, glob: str = SOURCE_GLOB) -> DataFrame:
    """SRC-1: recursive scan of ``root`` for source files: path, mtime, length, content."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root)
            .select("path", F.col("modificationTime").alias("mtime"), "length", "content"))


def directory_parts(path_col, root: str):
    """Parts of the path below the root, without the file name.  ``root`` must be
    given in the listing's qualified form (scheme included)."""
    rel = relative_path(path_col, root)
    parts = split_path(rel)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def prune(files: DataFrame, path_col: str, root: str, prune_list: list[str]) -> DataFrame:
    """SRC-2: drop files below a directory whose name *contains* a pruned word
    (a substring test: '.github' goes with '.git').  File names are not tested."""
    if not prune_list:
        return files
    dirs = directory_parts(F.col(path_col), root)
    return files.filter(~F.exists(dirs, lambda d: _any_contains(d, prune_list)))


def _any_contains(d, words):
    expr = None
    for w in words:
        c = d.contains(w)
        expr = c if expr is None else expr | c
    return expr


def decode(files: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """SRC-8: decode content as UTF-8.  Returns (decoded, rejected): files that are
    not valid UTF-8 go to the reject table (workspace passes may choose ``strict``
    to fail instead)."""
    ok = F.is_valid_utf8(F.col("content"))
    good = files.filter(ok).withColumn("text", F.decode("content", "UTF-8")).drop("content")
    bad = files.filter(~ok).drop("content")
    if strict and not bad.isEmpty():
        raise ValueError("workspace file is not valid UTF-8")
    return good, bad


def lockfile_entries(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC-3: (name, version) of lockfile lines with exactly four leading blanks."""
    return (lines.select(F.regexp_extract(col, LOCK_PATTERN, 1).alias("name"),
                         F.regexp_extract(col, LOCK_PATTERN, 2).alias("version"))
            .filter(F.col("name") != ""))


def dependency_roots(entries: DataFrame, home: str, stdlib_root: str | None) -> DataFrame:
    """SRC-4: one interface-only, non-user root per lock entry, plus the language's
    own library root."""
    roots = entries.select(F.concat(F.lit(home.rstrip("/") + "/gems/"), F.col("name"), F.lit("-"),
                                    F.col("version")).alias("root"))
    if stdlib_root:
        roots = roots.unionByName(entries.sparkSession.range(1).select(F.lit(stdlib_root).alias("root")))
    return roots.select("root", F.lit(True).alias("interface_only"), F.lit(False).alias("user_space"))


def included_roots(dirs: DataFrame, workspace: str) -> DataFrame:
    """SRC-5: configured directories; relative paths are resolved against the
    workspace; interface_only defaults to true; never user space."""
    p = F.col("path")
    root = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(workspace.rstrip("/") + "/"), p))
    return dirs.select(root.alias("root"), F.coalesce("interface_only", F.lit(True)).alias("interface_only"),
                       F.lit(False).alias("user_space")).distinct()


def source_union(workspace: DataFrame, included: DataFrame, deps: DataFrame | None) -> DataFrame:
    """SRC-7 / SET-1: workspace, then included, then dependency roots; distinct."""
    u = workspace.withColumn("source", F.lit("workspace")).unionByName(
        included.withColumn("source", F.lit("included")))
    if deps is not None:
        u = u.unionByName(deps.withColumn("source", F.lit("dependencies")))
    return u.distinct()


__all__ = ["scan_tree", "prune", "decode", "lockfile_entries", "dependency_roots", "included_roots",
           "source_union", "file_key", "directory_parts"]
