"""Session helpers: a local session for tests/bench and the shared work folder.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it.  A folder of our own is chosen only when that
setting is unset (local runs and tests).
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus: str = "*", app: str = "scopeforge", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**_LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and derived tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint
    dir); only when neither is set in a single-machine session (local tests) a fresh
    temporary folder is made.  Elsewhere a machine's own folder would not be shared.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="scopeforge-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system (works for local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


PACKED = "zstd"         # codec of stored tables that are as large as the index
_OPEN = threading.local()       # stage tables of the open scopes of this thread, inner ones last
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def stages(spark: SparkSession):
    """Stage tables that are written inside are removed at the end, and the shuffle files of
    each write with it, so that a long job holds the disk of its present step only.  What is
    read later has to be stored elsewhere, or made by ``computed``."""
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            delete_path(spark, path)


@contextlib.contextmanager
def tidy(spark: SparkSession, always: bool = False):
    """Inside ``stages``, or ``always``, an action removes its shuffle files when it ends."""
    held = spark.conf.get(_CLEANUP, "false")
    if always or getattr(_OPEN, "scopes", None):
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, held)


def stage_path(spark: SparkSession, label: str) -> str:
    """A new folder for a stage table, removed with the scope that is open, if any."""
    path = f"{shared_dir(spark)}/stages/{label}-{uuid.uuid4().hex[:12]}"
    if getattr(_OPEN, "scopes", None):
        _OPEN.scopes[-1].append(path)
    return path


def materialize(df, label: str = "stage", lean: bool = False):
    """Cut the lineage by writing ``df`` as Parquet into the shared folder and
    reading it back.  Computed once (a reliable ``checkpoint()`` without a cache
    would compute it twice), survives executor loss, and the read-back side has
    exact size statistics for the next join decision.  ``lean``: packed more tightly,
    and its shuffle files go at once."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    with tidy(spark, lean):
        df.write.mode("overwrite").option("compression", PACKED if lean else "snappy").parquet(path)
    return spark.read.parquet(path)


def computed(spark: SparkSession, make, label: str = "stage"):
    """The table that ``make`` gives, written, without the stage tables it was made from."""
    path = stage_path(spark, label)
    with stages(spark):
        df = make()
        with tidy(df.sparkSession):
            df.write.mode("overwrite").option("compression", PACKED).parquet(path)
    return spark.read.parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_once(spark: SparkSession, path: str, write) -> None:
    """Create the table at ``path`` exactly once.

    ``write(tmp_path)`` writes to a private folder, which is then renamed into
    place (atomic on HDFS and local file systems).  When another job published
    the same table first, its copy is kept and ours is dropped.
    """
    if path_exists(spark, path):
        return
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
    write(tmp)
    fs, dst = _fs(spark, path)
    fs.mkdirs(dst.getParent())
    _, src = _fs(spark, tmp)
    if not fs.rename(src, dst):
        fs.delete(src, True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of a stored table, if it is there."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """Fully qualified form of a path (scheme included), as file listings report it."""
    fs, p = _fs(spark, path)
    return str(fs.makeQualified(p).toString())
