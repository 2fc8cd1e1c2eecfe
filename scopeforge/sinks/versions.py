"""Index versions with readers (SNK-2 .. SNK-5): bucketed Parquet tables below one folder,
and one pointer file a version.

A pass writes the buckets that it touches to a folder of its own (``<table>/pass=<id>/
bucket=<n>``) and never overwrites a file.  Its pointer, ``versions/<number>.json``, names
for every table the folder that holds each bucket; it is written aside and renamed, so a
version is visible whole or not at all, and a pass that fails leaves the last one.  A reader
keeps the buckets of the version that it opened.  One writer at a time; a second one that
wants the same number fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..operators.skew import broadcast_if_small, shuffled
from ..session import PACKED, _fs, delete_path, materialize, path_exists, tidy
from .index import bucket_of, side_by_side

#: Bytes of input that a bucket of a new table should hold, and the most buckets.
BUCKET_BYTES, MAX_BUCKETS = 8 << 20, 1 << 16


def buckets_for(input_bytes: int, least: int) -> int:
    """Buckets of a table made from ``input_bytes``: a small pass then rewrites a small part."""
    return int(min(MAX_BUCKETS, max(least, -(-input_bytes // BUCKET_BYTES))))


@dataclass(frozen=True)
class Snapshot:
    """One published version."""
    spark: SparkSession
    home: str
    number: int
    info: dict
    tables: dict = field(repr=False)

    def buckets(self, name: str) -> int:
        return self.tables[name]["buckets"]

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """Rows of a table with their ``bucket``; with ``only``, of those buckets."""
        t = self.tables[name]
        schema = StructType.fromJson(t["schema"])
        live = {int(b): p for b, p in t["live"].items() if only is None or int(b) in set(only)}
        if not live:
            return self.spark.createDataFrame([], schema.add("bucket", IntegerType()))
        base = f"{self.home}/{name}"
        found = self.spark.read.schema(schema).option("basePath", base).parquet(
            *[f"{base}/pass={p}/bucket={b}" for b, p in sorted(live.items())])
        return found.drop("pass").withColumn("bucket", F.col("bucket").cast("int"))


class Store:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def versions(self) -> list[int]:
        if not path_exists(self.spark, f"{self.home}/versions"):
            return []
        fs, p = _fs(self.spark, f"{self.home}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def open(self, number: int | None = None) -> Snapshot | None:
        """The version ``number``, or the last one; None before the first."""
        known = self.versions()
        if not known:
            return None
        number = known[-1] if number is None else number
        text = self.spark.read.text(f"{self.home}/versions/{number:012d}.json", wholetext=True).first()["value"]
        return Snapshot(self.spark, self.home, **json.loads(text))

    def begin(self) -> Draft:
        return Draft(self, self.open())

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions and the pass folders that only they use.
        Not beside a running pass or a reader of an older version."""
        known = self.versions()
        used = {(name, p) for n in known[-keep:] for name, t in self.open(n).tables.items() for p in t["live"].values()}
        for n in known[:-keep]:
            delete_path(self.spark, f"{self.home}/versions/{n:012d}.json")
        for name in {name for name, _ in used}:
            fs, p = _fs(self.spark, f"{self.home}/{name}")
            for s in fs.listStatus(p):
                if (name, s.getPath().getName().removeprefix("pass=")) not in used:
                    fs.delete(s.getPath(), True)


class Draft:
    """The next version: tables not written are the last version's."""

    def __init__(self, store: Store, base: Snapshot | None):
        self.store, self.base = store, base
        self.id = f"p{uuid.uuid4().hex[:12]}"
        self.tables = {k: dict(t) for k, t in base.tables.items()} if base else {}

    def create(self, name: str, rows: DataFrame, key: str, buckets: int, order: list[str], dealt: bool = False) -> None:
        """SNK-1: a whole table, in buckets of ``key``; files in the order of ``order``.  ``dealt``:
        the rows come from files of ``deal_by_bucket``, in their order, and are written as they come."""
        plain = rows.drop("bucket")
        self.tables[name] = {"key": key, "buckets": buckets, "order": order, "live": {},
                             "schema": json.loads(plain.schema.json())}
        self._write(name, plain, None, dealt)

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """Buckets of the rows of ``keys`` (with the table's key): at most all buckets."""
        t = self.tables[name]
        own = keys.select(bucket_of(t["key"], t["buckets"]).alias("b")).distinct()
        return sorted(r["b"] for r in own.collect())

    def rewrite(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        """The ``touched`` buckets now hold ``rows``; empty ones go."""
        self._write(name, rows.drop("bucket"), touched)

    def replace(self, name: str, new_rows: DataFrame, gone: DataFrame) -> DataFrame:
        """SNK-2 / SNK-3: rows of the keys ``gone`` leave, ``new_rows`` come; returns the rows
        that left."""
        t = self.tables[name]
        touched = self.touched(name, gone.select(t["key"]).unionByName(new_rows.select(t["key"])))
        old = self.base.table(name, touched).drop("bucket") if self.base and name in self.base.tables else new_rows.limit(0)
        # a checked small list of keys keeps the old rows where they are read
        keys, small = broadcast_if_small(gone.select(t["key"]).distinct())
        keys = keys if small else shuffled(keys)
        left = materialize(old.join(keys, t["key"], "left_semi").select(*old.columns), f"{name}-left")
        kept = old.join(keys, t["key"], "left_anti")
        self._write(name, kept.unionByName(new_rows.select(*old.columns)), touched)
        return left

    def _write(self, name: str, rows: DataFrame, touched: list[int] | None, dealt: bool = False) -> None:
        t = self.tables[name]
        path = f"{self.store.home}/{name}/pass={self.id}"
        if touched is None or touched:
            own = rows.select(*StructType.fromJson(t["schema"]).names).withColumn("bucket", bucket_of(t["key"], t["buckets"]))
            if not dealt:
                # a bucket may be split over files, each sorted, so that row groups hold close keys
                own = own.hint("rebalance", "bucket").sortWithinPartitions("bucket", *t["order"])
            with tidy(own.sparkSession), side_by_side(own.sparkSession, dealt):
                own.write.mode("overwrite").option("compression", PACKED).partitionBy("bucket").parquet(path)
        live = {b: p for b, p in t["live"].items() if touched is not None and int(b) not in set(touched)}
        if path_exists(self.store.spark, path):
            fs, p = _fs(self.store.spark, path)
            names = [s.getPath().getName() for s in fs.listStatus(p)]
            live |= {n.removeprefix("bucket="): self.id for n in names if n.startswith("bucket=")}
        self.tables[name] = t | {"live": live}

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A table as this version will have it."""
        return Snapshot(self.store.spark, self.store.home, 0, {}, self.tables).table(name, only)

    def publish(self, info: dict) -> Snapshot:
        """SNK-4: make the version visible by one rename."""
        number = (self.base.number if self.base else 0) + 1
        fs, target = _fs(self.store.spark, f"{self.store.home}/versions/{number:012d}.json")
        _, aside = _fs(self.store.spark, f"{self.store.home}/versions/_{self.id}")
        fs.mkdirs(target.getParent())
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"number": number, "info": info, "tables": self.tables}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise RuntimeError(f"version {number} was published by another writer")
        return self.store.open(number)
