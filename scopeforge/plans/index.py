"""The symbol index of a data directory, written once to the shared folder,
with its score statistics stored next to it (AGG-1 per index version)."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import ScoreStats, field_stats, idf, term_stats
from ..session import _fs, shared_dir, stages, tidy, write_once
from ..sinks.index import bucket_count, deal_by_bucket, write_symbols
from ..sources import fixtures as fx


def _code_version() -> str:
    """Hash of the modules that decide the index contents, so a changed mapping
    never reuses an index written by older code."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for rel in ("rules.py", "sources/fixtures.py", "operators/extract.py", "functions/text.py",
                "operators/stats.py", "operators/search.py", "operators/upkeep.py", "sinks/index.py", "sinks/versions.py",
                "sources/roots.py", "streaming/passes.py"):
        with open(os.path.join(here, rel), "rb") as f:
            h.update(f.read())
    return h.hexdigest()[:12]


CODE_VERSION = _code_version()


def input_key(spark: SparkSession, path: str) -> str:
    """Digest of the files of a table: paths, lengths and times of change.  New data under
    an old name has another key, so nothing stored is taken for it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return "none"
    found, entries = fs.listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        entries.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(entries)).encode()).hexdigest()[:16]


def index_path(spark: SparkSession, sf_dir: str) -> str:
    listing = input_key(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    key = hashlib.sha1(f"{CODE_VERSION}:{sf_dir.rstrip('/')}:{listing}".encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/symbol_index/{key}"


def symbol_index(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> DataFrame:
    """Symbols of the documents fixture as a stored Parquet index, without their bucket."""
    return bucketed_index(spark, sf_dir, buckets)[0].drop("bucket")


def bucketed_index(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> tuple[DataFrame, int]:
    """(symbols with their bucket, number of buckets) of the stored index.

    Writing the index cuts the lineage (tokenising is done once, later scans read
    columnar data with pushdown) and makes it survive executor loss.
    """
    path = index_path(spark, sf_dir)
    b = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def build(p: str) -> None:
        docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
        docs = deal_by_bucket(docs, "doc_id", "text", b, int(spark.conf.get("spark.sql.shuffle.partitions")))
        write_symbols(fx.document_symbols(spark, docs, dealt=True), p, buckets=b, dealt=True)

    write_once(spark, f"{path}/symbols", _lean(spark, build))
    return spark.read.parquet(f"{path}/symbols"), bucket_count(spark, f"{path}/symbols")


def index_stats(spark: SparkSession, sf_dir: str) -> ScoreStats:
    """Score statistics of the stored index, computed once and kept beside it."""
    path = index_path(spark, sf_dir)
    idx = symbol_index(spark, sf_dir)
    write_once(spark, f"{path}/fields", _lean(spark, lambda p: field_stats(idx).write.parquet(p)))
    row = spark.read.parquet(f"{path}/fields").first()
    n_docs = int(row["n_docs"])
    write_once(spark, f"{path}/terms", _lean(spark, lambda p: term_stats(idx).withColumn(
        "idf", idf(F.col("df"), n_docs)).write.parquet(p)))
    return ScoreStats(n_docs, float(row["avg_len"] or 0.0), spark.read.parquet(f"{path}/terms"))


def _lean(spark: SparkSession, write):
    """A writer that leaves neither stage tables nor shuffle files."""
    def run(path: str) -> None:
        with stages(spark), tidy(spark):
            write(path)
    return run


#: Bytes of the stored index for which the members of its scope groups are made and searched at once.
PART_BYTES = 2 << 30


def definition_groups(spark: SparkSession, sf_dir: str, limit: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Scope groups of the assignments, their first ``limit`` members, the limit and the number
    of parts, stored once per index version (input of cross-file definition search)."""
    from ..operators.search import groups_of, write_members
    home = index_path(spark, sf_dir)
    idx = symbol_index(spark, sf_dir)
    fs, p = _fs(spark, f"{home}/symbols")
    parts = max(1, -(-fs.getContentSummary(p).getLength() // PART_BYTES))
    path = f"{home}/def_members_{limit}_{parts}"
    write_once(spark, path, lambda p: write_members(idx, "assignment", limit, p, parts))
    members = spark.read.parquet(path)
    return groups_of(members), members, limit, parts
