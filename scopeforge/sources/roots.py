"""Scans over many roots at once (SRC-4, SRC-5, SRC-7): the workspace, included folders and
dependency folders, one inside another or not.

Roots are configuration: their list is read by the driver, which asks the file system which
of them are there.  Files are listed over the outermost roots; each belongs to the longest
root above it and takes that root's flags and prune list.

Folders of a mounted file system (``file:``) are walked, and their files read, by the tasks
themselves, many folders and files a task; the listing is a table that the driver does not
hold.  Other stores are listed and read by the ``binaryFile`` source.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_key, relative_path
from ..operators.skew import broadcast_if_small
from ..session import materialize, path_exists, qualified
from .files import (OTHER_PRUNE, SOURCE_GLOB, WORKSPACE_PRUNE, dependency_roots, included_roots, lockfile_entries)

LOG = logging.getLogger(__name__)
LOCKFILE = "Gemfile.lock"
#: Sources in the order in which they are indexed; of equal roots the first one's flags count.
SOURCES = ["workspace", "included", "dependencies"]
FLAGS = "root string, interface_only boolean, user_space boolean"
LISTING = ("path string, mtime timestamp, length long, root string, source string, interface_only boolean, "
           "user_space boolean, rel_path string, file_path string")
#: Folders that a task of the walk begins with, and those that it lists before it hands the rest on.
TASK_FOLDERS, TASK_LISTED = 5_000, 10_000
#: Bytes of files that a task reads, each with what opening it costs, and bytes of a batch of them.
TASK_BYTES, OPEN_BYTES, BATCH_BYTES = 32 << 20, 4 << 10, 16 << 20


def lockfile_roots(spark: SparkSession, workspace: str, home: str, stdlib_root: str | None,
                   lockfile: str = LOCKFILE) -> DataFrame:
    """SRC-4: the roots of a workspace's lockfile; none, and a log line, without one."""
    path = f"{workspace.rstrip('/')}/{lockfile}"
    if not path_exists(spark, path):
        LOG.info("%s not found, dependencies are not scanned", path)
        return spark.createDataFrame([], FLAGS)
    return dependency_roots(lockfile_entries(spark.read.text(path)), home, stdlib_root)


def all_roots(spark: SparkSession, workspace: str, include_dirs: DataFrame | None = None, home: str | None = None,
              stdlib_root: str | None = None, include_dependencies: bool = True) -> DataFrame:
    """SRC-7 / CFG-1 / CFG-2: the roots of a run with their flags, each root once."""
    found = spark.createDataFrame([(workspace, False, True)], FLAGS) \
        .withColumn("source", F.lit(SOURCES[0]))
    if include_dirs is not None:
        found = found.unionByName(included_roots(include_dirs, workspace).withColumn("source", F.lit(SOURCES[1])))
    if include_dependencies and home is not None:
        found = found.unionByName(lockfile_roots(spark, workspace, home, stdlib_root).withColumn("source", F.lit(SOURCES[2])))
    prune = F.when(F.col("source") == SOURCES[0], F.array(*map(F.lit, WORKSPACE_PRUNE))).otherwise(
        F.array(*map(F.lit, OTHER_PRUNE)))
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    # a folder that is included twice, once whole and once for its interface, is taken whole
    first = F.min(F.struct(order.alias("o"), "interface_only", "user_space", "source", "prune")).alias("f")
    return found.withColumn("prune", prune).groupBy(F.rtrim("root", F.lit("/")).alias("root")).agg(first).select(
        "root", "f.interface_only", "f.user_space", "f.source", "f.prune")


def present_roots(spark: SparkSession, roots: DataFrame) -> tuple[DataFrame, list[str]]:
    """The roots that are there, in the form in which listings report paths (``at``), and the
    outermost of them."""
    rows = [(r["root"], qualified(spark, r["root"]).rstrip("/")) for r in roots.select("root").collect()
            if path_exists(spark, r["root"])]
    held = {at for _, at in rows}
    outer = sorted(at for at in held if not any(above in held for above in _above(at)))
    return roots.join(F.broadcast(spark.createDataFrame(rows, "root string, at string")), "root"), outer


def _above(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(1, len(parts))]


def list_files(spark: SparkSession, roots: DataFrame, workspace: str, glob: str = SOURCE_GLOB,
               scan: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """Every source file below the roots, once, with the flags of its own root; with ``scan``
    only files that belong to those of the roots:

    (path, mtime, length, root, source, interface_only, user_space, rel_path, file_path, file_id).
    ``rel_path`` is below the own root; ``file_path`` is relative to the workspace inside it,
    else absolute (FN-2), and ``file_id`` its key (``key`` of these columns, if given).  Files
    below a pruned folder are left out.  Contents are not read."""
    here, outer = present_roots(spark, roots)
    if scan is not None:
        outer = present_roots(spark, scan)[1]
    if not outer:
        return spark.createDataFrame([], LISTING).withColumn("file_id", file_key("file_path") if key is None else key)
    files = _listed(spark, outer, glob)
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    held, _ = broadcast_if_small(here)  # configuration rows, with their paths
    flags = F.struct(F.length("at").alias("n"), "at", "root", "source", "interface_only", "user_space", "prune")
    own = (files.withColumn("at", F.explode(above)).join(held, "at")
           .groupBy("path", "mtime", "length").agg(F.max(flags).alias("own")))
    if scan is not None:
        own = own.join(scan.select("root"), F.col("own.root") == F.col("root"), "left_semi")
    rel = F.expr("substr(path, own.n + 1)")
    dirs = F.expr("slice(split(substr(path, own.n + 2), '/'), 1, size(split(substr(path, own.n + 2), '/')) - 1)")
    pruned = F.exists(dirs, lambda d: F.exists("own.prune", lambda word: F.contains(d, word)))
    plain = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?(?=/)", "")
    base = qualified(spark, workspace).rstrip("/")
    inside = F.startswith(F.col("path"), F.lit(base + "/"))
    file_path = F.when(inside, relative_path("path", base)).otherwise(plain)
    return (own.filter(~pruned).select("path", "mtime", "length", "own.root", "own.source", "own.interface_only",
                                       "own.user_space", rel.alias("rel_path"), file_path.alias("file_path"))
            .withColumn("file_id", file_key("file_path") if key is None else key))


def mounted(paths: list[str]) -> bool:
    """Whether all (qualified) paths are of a file system that tasks can open by name."""
    return all(p.startswith("file:/") for p in paths)


def local_name(path: str) -> str:
    """The name of a ``file:`` path in the operating system."""
    return "/" + path.removeprefix("file:").lstrip("/")


def _listed(spark: SparkSession, outer: list[str], glob: str) -> DataFrame:
    """(path, mtime, length) of the files below ``outer`` whose name matches ``glob``."""
    if not mounted(outer):
        return _binary(spark, outer, glob).select("path", F.col("modificationTime").alias("mtime"), "length")
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    return _walked(spark, outer).filter(F.substring_index("path", "/", -1).rlike(f"^(?s:{name})$")).select(
        "path", F.timestamp_millis("mtime").alias("mtime"), "length")


def _walked(spark: SparkSession, outer: list[str], most: int = TASK_LISTED) -> DataFrame:
    """(path, mtime in milliseconds, length) of all files below folders of a mounted file system.

    A task lists what is below its folders up to ``most`` folders; those that are left
    are dealt out again, so one deep or wide folder is not the work of one task."""
    todo, found = spark.createDataFrame([(p,) for p in outer], "path string").coalesce(1), None
    while True:
        seen = materialize(todo.mapInArrow(partial(_list_folders, most), "path string, mtime long, length long"), "walked")
        files, rest = seen.filter("length IS NOT NULL"), seen.filter("length IS NULL").select("path")
        found = files if found is None else found.unionByName(files)
        n = rest.count()
        if not n:
            return found
        todo = rest.repartition(-(-n // TASK_FOLDERS), "path")


def _list_folders(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files below the folders, as the file source lists them: names that begin with ``_`` (unless
    they hold ``=``) or ``.`` are hidden, and what goes meanwhile is not there.  Folders beyond
    ``most`` come back without a length."""
    todo, rows, listed = [p for b in batches for p in b.column(0).to_pylist()][::-1], [], 0
    while todo and listed < most:
        folder, listed = todo.pop(), listed + 1
        try:
            entries = list(os.scandir(local_name(folder)))
        except FileNotFoundError:
            continue
        for e in entries:
            if e.name.startswith(".") or e.name.endswith("._COPYING_") or (e.name.startswith("_") and "=" not in e.name):
                continue
            try:
                e.name.encode()
                if e.is_dir():
                    todo.append(f"{folder}/{e.name}")
                else:
                    at = e.stat()
                    rows.append((f"{folder}/{e.name}", at.st_mtime_ns // 1_000_000, at.st_size))
            except (FileNotFoundError, UnicodeEncodeError):
                continue
        if len(rows) >= 10_000:
            yield _listing_batch(rows)
            rows = []
    yield _listing_batch(rows + [(p, None, None) for p in todo])


def _listing_batch(rows: list[tuple]) -> pa.RecordBatch:
    path, mtime, length = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(mtime, pa.int64()), pa.array(length, pa.int64())],
                                      ["path", "mtime", "length"])


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the ``content`` of their ``path``."""
    for batch in batches:
        contents, size, begin = [], 0, 0
        for i, path in enumerate(batch.column("path").to_pylist()):
            with open(local_name(path), "rb") as f:
                contents.append(f.read())
            size += len(contents[-1])
            if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                part = batch.slice(begin, i + 1 - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], [*part.schema.names, "content"])
                contents, size, begin = [], 0, i + 1


def _binary(spark: SparkSession, paths: list[str], glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(paths))


def read_contents(spark: SparkSession, roots: DataFrame, chosen: DataFrame, glob: str = SOURCE_GLOB) -> DataFrame:
    """``chosen`` rows of a listing with their ``content``; no other file is opened, or, where the
    ``binaryFile`` source reads them, none that is older than all of them."""
    _, outer = present_roots(spark, roots)
    oldest, n, size = chosen.agg(F.min("mtime"), F.count(F.lit(1)), F.sum("length")).first()
    if not outer or oldest is None:
        return chosen.withColumn("content", F.lit(None).cast("binary"))
    if mounted(outer):
        tasks = max(min(n, spark.sparkContext.defaultParallelism), -(-(size + n * OPEN_BYTES) // TASK_BYTES))
        schema = chosen.withColumn("content", F.lit(b"")).schema
        return chosen.repartition(tasks, "path").mapInArrow(_read_files, schema)
    files = _binary(spark, outer, glob).filter(F.col("modificationTime") >= F.lit(oldest)).select("path", "content")
    wanted, _ = broadcast_if_small(chosen)
    return files.join(wanted, "path").select(*chosen.columns, "content")
