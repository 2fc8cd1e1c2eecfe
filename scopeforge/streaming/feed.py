"""Change-feed semantics shared by the batch passes and the streaming replays.

A feed row is one editor or file-system event: (file_id, version, event_type,
text, ts).  ``open`` publishes diagnostics only; ``change`` / ``save`` reindex;
``failed`` is a text that did not parse (the index keeps the old rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixture mapping of the driver's events (FIXTURES.md §2.4).
EVENT_KINDS = [("signup", "open"), ("view", "change"), ("click", "change"),
               ("purchase", "save"), ("error", "failed")]
REINDEX_EVENTS = ["change", "save"]
PASS_SECONDS = 600
OVERLAP_SECONDS = 1


def events_feed(events: DataFrame) -> DataFrame:
    kinds = F.create_map(*[x for k, v in EVENT_KINDS for x in (F.lit(k), F.lit(v))])
    return events.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("version"),
                         kinds[F.col("event_type")].alias("event_type"), F.col("props").alias("text"), "ts")


def latest_text(feed: DataFrame) -> DataFrame:
    """ST-4 / ST-7: the indexed text of each file is its last reindexing event by
    version (late events with a lower version lose)."""
    w = Window.partitionBy("file_id").orderBy(F.col("version").desc())
    return (feed.filter(F.col("event_type").isin(REINDEX_EVENTS))
            .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
            .select("file_id", "version", "text", "ts"))


def latest_text_agg(feed: DataFrame) -> DataFrame:
    """The same as ``latest_text`` as a grouped max: partial aggregation before the
    shuffle, so a file with a huge number of edits is pre-reduced per task."""
    m = (feed.filter(F.col("event_type").isin(REINDEX_EVENTS)).groupBy("file_id")
         .agg(F.max(F.struct("version", "text", "ts")).alias("m")))
    return m.select("file_id", "m.version", "m.text", "m.ts")


def with_day(feed: DataFrame) -> DataFrame:
    return feed.withColumn("day", F.to_date("ts"))


def changed_files(feed: DataFrame) -> DataFrame:
    """ST-2: pass of day d takes files modified at or after its start minus 1 s
    (the overlap re-delivers a few files on purpose; replacing is idempotent)."""
    f = feed.withColumn("_day", F.to_date("ts"))
    days = f.select(F.col("_day").alias("pass_day")).distinct()
    lo = F.col("pass_day").cast("timestamp") - F.expr(f"INTERVAL {OVERLAP_SECONDS} SECONDS")
    hi = F.date_add("pass_day", 1).cast("timestamp")
    # a range join on time, binned by day: an event can only fall into its own
    # day's pass or (inside the overlap) the next day's
    ev = f.select("file_id", "ts", F.explode(F.array(F.col("_day"), F.date_add("_day", 1))).alias("pass_day"))
    return (ev.join(days, "pass_day").filter((F.col("ts") >= lo) & (F.col("ts") < hi))
            .select("pass_day", "file_id").distinct())


def deleted_files(feed: DataFrame) -> DataFrame:
    """ST-3: files present in day d's pass and absent from day d + 1's."""
    f = feed.select("file_id", F.to_date("ts").alias("day")).distinct()
    days = f.select("day").distinct()
    prev = f.select("file_id", F.date_add("day", 1).alias("pass_day"))
    prev = prev.join(days.withColumnRenamed("day", "pass_day"), "pass_day")
    cur = f.withColumnRenamed("day", "pass_day")
    return prev.join(cur, ["pass_day", "file_id"], "left_anti")


def pass_grid(feed: DataFrame, seconds: int = PASS_SECONDS) -> DataFrame:
    """ST-1 / SNK-5: every periodic pass between the first and last event, with its
    number of changes and whether it is skipped (nothing changed)."""
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    counts = feed.groupBy((F.floor(sec / seconds) * seconds).alias("start_s")).agg(
        F.count(F.lit(1)).alias("n_changes"))
    bounds = feed.agg(F.min(sec).alias("lo"), F.max(sec).alias("hi"))
    grid = bounds.select(F.explode(F.sequence(F.floor(F.col("lo") / seconds) * seconds,
                                              F.floor(F.col("hi") / seconds) * seconds,
                                              F.lit(seconds).cast("bigint"))).alias("start_s"))
    return (grid.join(counts, "start_s", "left")
            .select(F.timestamp_seconds("start_s").cast("timestamp_ntz").alias("pass_start"),
                    F.coalesce("n_changes", F.lit(0)).cast("bigint").alias("n_changes"))
            .withColumn("skipped", F.col("n_changes") == 0))


def text_tokens(texts: DataFrame) -> DataFrame:
    """Index rows of a text: (file_id, tok_ix, token) for blank-separated pieces."""
    return texts.select("file_id", F.posexplode(F.split("text", " ", -1)).alias("tok_ix", "token")) \
        .withColumn("tok_ix", F.col("tok_ix").cast("bigint"))
