"""Index maintenance (SNK-1 .. SNK-5).

The index is Parquet partitioned by ``bucket = pmod(xxhash64(file_id), B)``.  A
pass rewrites only the buckets that hold changed or deleted files (dynamic
partition overwrite), and publishes the pass in a small ``versions`` table.
Writes go through a REBALANCE on the bucket so AQE splits a hot bucket (one
huge file) over several tasks instead of one; an index made from texts deals the texts
by bucket instead, which are a small part of its rows.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import PACKED, delete_path, materialize


#: Bytes of text that one task turns into rows of the index.
TASK_TEXT = 8 << 20
#: Buckets of a range that are written side by side; a range with more is sorted.
RANGE_BUCKETS = 16
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def layout_path(path: str) -> str:
    """Inside the index; readers skip names that begin with an underscore."""
    return f"{path.rstrip('/')}/_layout"


def bucket_count(spark: SparkSession, path: str) -> int:
    """Buckets that the index at ``path`` was written with."""
    return int(spark.read.parquet(layout_path(path)).first()["buckets"])


def bucket_of(file_id_col: str = "file_id", buckets: int = 64):
    return F.pmod(F.xxhash64(F.col(file_id_col)), F.lit(buckets)).cast("int")


def deal_by_bucket(files: DataFrame, key: str, text: str, buckets: int, least: int = 1) -> DataFrame:
    """Files in ranges of (bucket, key), about ``TASK_TEXT`` bytes of ``text`` each: what is
    made from a range needs no further shuffle to be written by bucket, and a large bucket
    is several ranges.  The files of a range are in order, so that their rows need no sort."""
    size = files.agg(F.sum(F.octet_length(text))).first()[0] or 0
    order = [bucket_of(key, buckets), F.col(key)]
    return files.repartitionByRange(max(least, -(-size // TASK_TEXT)), *order).sortWithinPartitions(*order)


@contextlib.contextmanager
def side_by_side(spark: SparkSession, dealt: bool):
    """Inside, a range of ``deal_by_bucket`` (if ``dealt``) holds the files of its buckets open:
    without them Spark sorts all its rows once more."""
    held = spark.conf.get(_OPEN_FILES)
    spark.conf.set(_OPEN_FILES, str(RANGE_BUCKETS) if dealt else held)
    try:
        yield
    finally:
        spark.conf.set(_OPEN_FILES, held)


def write_symbols(symbols: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite", dealt: bool = False) -> None:
    """SNK-1: write symbol rows with their bucket column, and the number of buckets beside
    them: a later pass reads it there, whatever its own settings are.  ``dealt``: the rows
    come from files of ``deal_by_bucket``, in their order, and are written as they come."""
    spark = symbols.sparkSession
    rows = symbols.withColumn("bucket", bucket_of("file_id", buckets))
    if not dealt:
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *[c for c in ("file_id", "line") if c in symbols.columns])
    with side_by_side(spark, dealt):
        rows.write.mode(mode).option("compression", PACKED).partitionBy("bucket").parquet(path)
    layout = spark.createDataFrame([(buckets,)], "buckets int")
    layout.coalesce(1).write.mode("overwrite").parquet(layout_path(path))


def replace_files(old: DataFrame, new_rows: DataFrame, changed: DataFrame,
                  deleted: DataFrame | None = None, key: str = "file_id") -> DataFrame:
    """SNK-2 / SNK-3: the index after one pass.

    Rows of changed and deleted files are removed (left-anti on the file key), the
    new rows of the changed files are added.  Replaying a pass is harmless:
    replace twice = replace once.
    """
    gone = changed.select(key)
    if deleted is not None:
        gone = gone.unionByName(deleted.select(key))
    kept = old.join(gone.distinct(), key, "left_anti")
    return kept.unionByName(new_rows.select(*old.columns))


def nothing_changed(changed: DataFrame, deleted: DataFrame | None = None) -> bool:
    """SNK-5: skip the pass (no write, no new version) when the change set is empty."""
    return changed.isEmpty() and (deleted is None or deleted.isEmpty())


def publish_versions(versions: DataFrame, versions_path: str) -> None:
    """SNK-4: append commit records (version, ... ) after the data writes
    succeeded; readers resolve the highest committed version."""
    versions.withColumn("committed_at", F.current_timestamp()).write.mode("append").parquet(versions_path)


def touched_buckets(changed: DataFrame, buckets: int, key: str = "file_id") -> DataFrame:
    """(bucket): the buckets of changed and deleted files, at most ``buckets`` rows."""
    return changed.select(bucket_of(key, buckets).alias("bucket")).distinct()


def replace_in_index(path: str, new_rows: DataFrame, changed: DataFrame, deleted: DataFrame | None = None,
                     key: str = "file_id") -> None:
    """SNK-2 / SNK-3 on a stored index: one pass over the buckets of the changed and
    deleted files; a bucket that nothing is left of is emptied."""
    spark = new_rows.sparkSession
    buckets = bucket_count(spark, path)
    gone = changed.select(key) if deleted is None else changed.select(key).unionByName(deleted.select(key))
    gone = materialize(gone.distinct(), "replace-files")
    touched = materialize(touched_buckets(gone, buckets, key), "replace-buckets")
    old = spark.read.parquet(path).join(F.broadcast(touched), "bucket").drop("bucket")
    merged = materialize(replace_files(old, new_rows, gone, key=key), "replace")
    overwrite_buckets(merged, path, buckets, touched)


def overwrite_buckets(rows: DataFrame, path: str, buckets: int = 64, touched: DataFrame | None = None) -> None:
    """Write only the buckets present in ``rows`` (dynamic partition overwrite).  Buckets of
    ``touched`` that have no row any more are removed."""
    if touched is not None:
        spark = rows.sparkSession
        left = rows.select(bucket_of("file_id", buckets).alias("bucket")).distinct()
        for r in touched.join(left, "bucket", "left_anti").collect():  # <= buckets rows
            delete_path(spark, f"{path.rstrip('/')}/bucket={r['bucket']}")
    (rows.withColumn("bucket", bucket_of("file_id", buckets))
     .hint("rebalance", "bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
