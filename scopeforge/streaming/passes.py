"""Index passes over source roots (ST-1 .. ST-3, ST-6, SNK-2 .. SNK-7, CFG-1 .. CFG-3).

One pass lists the roots, takes the files that changed since the last published pass began
(less a second), drops those that vanished, extracts, and publishes symbols, statistics,
scope groups, diagnostics, the files' state and the outcome of each root as one version.
A pass that finds no change publishes nothing.  One that fails leaves the last version and
its mark, so its files are found again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators import search as S
from ..operators import upkeep as U
from ..operators.skew import broadcast_if_small, shuffled
from ..operators.stats import ScoreStats, idf, term_stats
from ..session import computed, materialize, stages
from ..sinks.index import deal_by_bucket, nothing_changed
from ..sinks.versions import Draft, Snapshot, Store, buckets_for
from ..sources.files import SOURCE_GLOB, decode
from ..sources.roots import SOURCES, all_roots, list_files, present_roots, read_contents
from .feed import OVERLAP_SECONDS, REINDEX_EVENTS

STATE = ["file_id", "path", "file_path", "root", "source", "interface_only", "user_space", "mtime", "length"]
REGISTRY = "root string, source string, status string"


@dataclass(frozen=True)
class Run:
    """What a pass indexes and how.

    ``extract(files)`` gives the symbols of (file_id, file_path, rel_path, interface_only,
    user_space, text); ``diagnose(files)`` the parser's messages with ``parse_ok``: a file
    with a false one has no syntax tree and keeps its old symbols (SNK-6)."""
    workspace: str
    extract: Callable[[DataFrame], DataFrame]
    diagnose: Callable[[DataFrame], DataFrame] | None = None
    include_dirs: DataFrame | None = None
    home: str | None = None
    stdlib_root: str | None = None
    include_dependencies: bool = True
    report_diagnostics: bool = True
    #: A workspace file that is not UTF-8 ends the pass, in place of keeping its old symbols.
    strict: bool = False
    glob: str = SOURCE_GLOB
    #: File key of a listing's columns, if not the hash of ``file_path``.
    key: Column | None = None
    limit: int = rules.DEFINITION_LIMIT
    #: ``extract`` makes the symbols of a file where the file is, in its order: the files are
    #: then dealt by bucket, and their symbols written without a shuffle.
    in_place: bool = False


def changed_since(listing: DataFrame, state: DataFrame, mark: int) -> DataFrame:
    """ST-2: files modified at or after ``mark`` (seconds), and files that the state lacks."""
    new = listing.join(shuffled(state.select("file_id")), "file_id", "left_anti")
    touched = listing.join(shuffled(state.select("file_id")), "file_id", "left_semi").filter(F.unix_seconds("mtime") >= mark)
    return new.unionByName(touched)


def vanished(listing: DataFrame, state: DataFrame) -> DataFrame:
    """ST-3: workspace files of the state that the listing lacks."""
    return state.filter(F.col("source") == SOURCES[0]).join(shuffled(listing.select("file_id")), "file_id", "left_anti")


def index_pass(spark: SparkSession, home: str, run: Run, now: float | None = None) -> Snapshot | None:
    """One pass onto the index at ``home``; the version that it publishes, or None."""
    with stages(spark):
        return _index_pass(spark, home, run, now)


def _index_pass(spark: SparkSession, home: str, run: Run, now: float | None) -> Snapshot | None:
    draft = Store(spark, home).begin()
    base = draft.base
    started = int(time.time() if now is None else now)
    roots = materialize(all_roots(spark, run.workspace, run.include_dirs, run.home, run.stdlib_root,
                                  run.include_dependencies), "roots")
    registry = base.table("roots").drop("bucket") if base else spark.createDataFrame([], REGISTRY)
    state = base.table("files").drop("bucket") if base else None
    done = registry.filter("status = 'done'")
    scan = materialize(roots.join(done.select("root"), "root", "left_anti"), "roots-to-scan")  # ST-6
    listing = materialize(list_files(spark, roots, run.workspace, run.glob, scan, run.key), "listing")
    if base:
        mark = base.info["started"] - OVERLAP_SECONDS
        changed, deleted = changed_since(listing, state, mark), vanished(listing, state)
    else:
        changed, deleted = listing.select(*listing.columns), listing.select(*STATE).limit(0)
    changed, deleted = materialize(changed, "changed"), materialize(deleted, "deleted")
    good, bad = decode(materialize(read_contents(spark, scan, changed, run.glob), "contents"), strict=False)
    bad = materialize(bad, "unreadable")
    if run.strict and not bad.filter(F.col("source") == SOURCES[0]).isEmpty():  # SRC-8
        raise ValueError("workspace file is not valid UTF-8")
    outcome = materialize(_registry(spark, roots, scan, bad, done), "registry")
    same = base is not None and outcome.exceptAll(registry.select(*outcome.columns)).isEmpty()
    if same and nothing_changed(changed.join(bad.select("file_id"), "file_id", "left_anti"), deleted):  # SNK-5
        return None
    good = materialize(good.select("file_id", "file_path", "rel_path", "interface_only", "user_space", "text"), "texts")
    messages = materialize(run.diagnose(good), "messages") if run.diagnose else None
    parsed = good
    if messages is not None:
        failed, _ = broadcast_if_small(messages.filter("NOT parse_ok").select("file_id").distinct())
        parsed = good.join(failed, "file_id", "left_anti")
    files = materialize(changed.join(shuffled(good.select("file_id")), "file_id", "left_semi").select(*STATE), "new-state")
    gone = materialize(parsed.select("file_id").unionByName(deleted.select("file_id")), "gone")
    seen = files.select("file_id").unionByName(deleted.select("file_id"))
    if base is None:
        info = _first(spark, draft, lambda buckets: run.extract(_dealt(spark, parsed, buckets, run)), files, run.limit, run.in_place)
    else:
        buckets = draft.tables["symbols"]["buckets"]
        came = computed(spark, lambda: run.extract(_dealt(spark, parsed, buckets, run)), "came")
        info = _next(draft, came, gone, run.limit)
        draft.replace("files", files, seen)
    if messages is not None and run.report_diagnostics:  # SNK-7, CFG-3
        rows = messages.drop("parse_ok")
        if "diagnostics" in draft.tables:
            draft.replace("diagnostics", rows, seen)
        else:
            draft.create("diagnostics", rows, "file_id", draft.tables["files"]["buckets"], ["file_id"])
    draft.create("roots", outcome, "root", 1, ["root"])
    return draft.publish(info | {"started": started, "n_changed": changed.count(), "n_deleted": deleted.count(),
                                 "limit": run.limit})


def _registry(spark, roots: DataFrame, scan: DataFrame, bad: DataFrame, done: DataFrame) -> DataFrame:
    """ST-6: the workspace stays open; a root that was scanned whole is done, one that is
    missing or has unreadable files stays pending."""
    here, _ = present_roots(spark, scan)
    rough = bad.select("root", F.lit(True).alias("rough")).distinct()
    status = (F.when(F.col("source") == SOURCES[0], "open")
              .when(F.col("here") & F.col("rough").isNull(), "done").otherwise("pending"))
    now = (scan.join(here.select("root", F.lit(True).alias("here")), "root", "left").join(rough, "root", "left")
           .withColumn("here", F.coalesce("here", F.lit(False))).select("root", "source", status.alias("status")))
    return now.unionByName(done.select("root", "source", "status"))


def change_files(spark: SparkSession, home: str, events: DataFrame, extract: Callable[[DataFrame], DataFrame],
                 diagnose: Callable[[DataFrame], DataFrame] | None = None, report_diagnostics: bool = True,
                 limit: int = rules.DEFINITION_LIMIT) -> Snapshot | None:
    """ST-4, ST-5, ST-7: events (file_id, version, event_type, length, ...) onto the index at ``home``.

    The symbols of a file become those that ``extract`` finds for its last event, by version,
    that asks for a reindex and has no message (SNK-6); a ``delete`` leaves none.  Its
    diagnostics become those of its last event of any kind.  ``diagnose`` gives the messages
    of events under their ``file_id``, which is the event's number here.  An event that is
    not later than the version that the index holds changes nothing, so late and repeated
    ones do no harm.  The held versions are tables of the index, bucketed as the symbols."""
    with stages(spark):
        return _change_files(spark, home, events, extract, diagnose, report_diagnostics, limit)


def _change_files(spark: SparkSession, home: str, events: DataFrame, extract: Callable[[DataFrame], DataFrame],
                  diagnose: Callable[[DataFrame], DataFrame] | None, report_diagnostics: bool, limit: int) -> Snapshot | None:
    draft = Store(spark, home).begin()
    events = materialize(events.withColumn("_event", F.monotonically_increasing_id()), "events")
    none = spark.createDataFrame([], "_event long")
    found = materialize(diagnose(events.drop("file_id").withColumnRenamed("_event", "file_id"))
                        .withColumnRenamed("file_id", "_event"), "event-messages") if diagnose else none
    good = events.filter(F.col("event_type").isin(*REINDEX_EVENTS, "delete")).join(shuffled(found.select("_event")), "_event", "left_anti")
    last = _newest(good, draft.base, "files")
    seen = _newest(events, draft.base, "seen") if diagnose and report_diagnostics else none
    if nothing_changed(last, seen):
        return None
    extracted = lambda _=0: extract(last.filter("event_type <> 'delete'"))
    files = last.select("file_id", "version", "length")
    if draft.base is None:
        info = _first(spark, draft, extracted, files, limit)
    else:
        came = computed(spark, extracted, "came")
        info = _next(draft, came, files.select("file_id"), limit)
        draft.replace("files", files, files.select("file_id"))
    if diagnose and report_diagnostics:
        keys, rows = seen.select("file_id", "version"), found.join(shuffled(seen.select("_event", "file_id")), "_event").drop("_event")
        for name, new in (("seen", keys), ("diagnostics", rows)):
            if name in draft.tables:
                draft.replace(name, new, keys.select("file_id"))
            else:
                draft.create(name, new, "file_id", draft.tables["files"]["buckets"], ["file_id"])
    return draft.publish(info | {"limit": limit, "n_changed": last.count()})


def _newest(events: DataFrame, base: Snapshot | None, held: str) -> DataFrame:
    """The last event of each file, by version, that is later than the one of table ``held``."""
    rest = [c for c in events.columns if c not in ("file_id", "version")]
    last = events.groupBy("file_id").agg(F.max(F.struct("version", "_event", *[c for c in rest if c != "_event"])).alias("e"))
    last = last.select("file_id", "e.*")
    if base and held in base.tables:
        old = base.table(held).select("file_id", F.col("version").alias("_held"))
        last = last.join(shuffled(old), "file_id", "left").filter("_held IS NULL OR version > _held").drop("_held")
    return materialize(last, "last-events")


def _dealt(spark: SparkSession, files: DataFrame, buckets: int, run: Run) -> DataFrame:
    if not run.in_place:
        return files
    return deal_by_bucket(files, "file_id", "text", buckets, spark.sparkContext.defaultParallelism)


def _first(spark: SparkSession, draft: Draft, extract: Callable[[int], DataFrame], files: DataFrame, limit: int,
           dealt: bool = False) -> dict:
    """The tables of a first version: the symbols that ``extract`` makes for a number of
    buckets (``dealt`` by them), and what is computed from these as they are stored."""
    size = files.agg(F.sum("length")).first()[0] or 0
    buckets = buckets_for(size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with stages(spark):
        draft.create("symbols", extract(buckets), "file_id", buckets, ["file_id", "line"], dealt)
    came = draft.read("symbols").drop("bucket")
    draft.create("files", files, "file_id", buckets, ["file_id"])
    draft.create("terms", term_stats(came), "term", buckets, ["term"])
    groups, members = S.scope_groups(came, "assignment", limit)
    draft.create("groups", groups, "name", buckets, S.GROUP_KEYS)
    draft.create("members", members, "name", buckets, S.GROUP_KEYS)
    n, total = U.lengths(came)
    return {"n_docs": n, "scope_names": total}


def _next(draft: Draft, came: DataFrame, gone: DataFrame, limit: int) -> dict:
    """Symbols replaced by file; statistics and groups changed by what left and came."""
    base = draft.base
    left = draft.replace("symbols", came, gone)
    delta = materialize(U.signed_terms(came, left), "term-changes")
    at = draft.touched("terms", delta)
    draft.rewrite("terms", U.merged_terms(base.table("terms", at), delta), at)
    both = came.select("name", "category").unionByName(left.select("name", "category")).filter("category = 'assignment'")
    at = draft.touched("groups", both.select("name"))
    groups, members = U.merged_groups(base.table("groups", at).drop("bucket"), came, left,
                                      base.table("members", at).drop("bucket"), draft.read("symbols").drop("bucket"),
                                      "assignment", min(limit, base.info["limit"]))
    draft.rewrite("groups", groups, at)
    draft.rewrite("members", members, at)
    (more, more_names), (less, less_names) = U.lengths(came), U.lengths(left)
    return {"n_docs": base.info["n_docs"] + more - less, "scope_names": base.info["scope_names"] + more_names - less_names}


def search_tables(version: Snapshot) -> tuple[DataFrame, ScoreStats, tuple[DataFrame, DataFrame, int], int]:
    """(symbols, statistics, scope groups, buckets) of a version, as the searches take them."""
    n = version.info["n_docs"]
    terms = version.table("terms").drop("bucket").withColumn("idf", idf(F.col("df"), n))
    stats = ScoreStats(n, version.info["scope_names"] / n if n else 0.0, terms)
    groups = version.table("groups").drop("bucket"), version.table("members").drop("bucket"), version.info["limit"]
    return version.table("symbols"), stats, groups, version.buckets("symbols")
