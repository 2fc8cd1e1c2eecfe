"""Parser messages -> diagnostics (EXT-13, Q-15, SNK-6, SNK-7, AGG-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import asof_lines


def to_diagnostics(messages: DataFrame, lines: DataFrame, key: str = "file_id") -> DataFrame:
    """Begin and end offsets become (line, column) through one as-of join on the line
    starts (FN-7 / J-6): a message is two offsets, and one row again after it."""
    offsets = messages.select(key, "msg_id", "message", F.explode(F.array(
        F.struct(F.lit("start").alias("side"), F.col("begin_off").alias("off")),
        F.struct(F.lit("end").alias("side"), F.col("end_off").alias("off")))).alias("_o")).select(
            key, "msg_id", "message", "_o.side", "_o.off")
    of = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))
    both = asof_lines(offsets, lines, key).groupBy(key, "msg_id", "message").agg(
        of("start", "line").alias("start_line"), of("start", "col").alias("start_col"),
        of("end", "line").alias("end_line"), of("end", "col").alias("end_col"))
    # a message whose offset lies in no line has no place
    return both.filter("start_line IS NOT NULL AND end_line IS NOT NULL").select(
        key, "start_line", "start_col", "end_line", "end_col", "message")


def by_file(diags: DataFrame, key: str = "file_id", page_lines: int | None = None) -> DataFrame:
    """AGG-4: all diagnostics of a file as one list (nulls dropped), flattened to text.

    A file may have any number of them: with ``page_lines`` a list holds those that begin in
    that many lines, under the page's number, so that no row and no task holds a whole file."""
    keys = [key]
    if page_lines:
        diags = diags.withColumn("page", F.floor(F.col("start_line") / page_lines))
        keys.append("page")
    lst = F.array_sort(F.collect_list(F.struct("start_line", "start_col", "end_line", "end_col", "message")))
    return diags.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_messages"), lst.alias("_l")).select(
        *keys, "n_messages",
        F.array_join(F.transform("_l", lambda d: F.concat_ws(
            ":", d["start_line"].cast("string"), d["start_col"].cast("string"),
            d["end_line"].cast("string"), d["end_col"].cast("string"))), ";").alias("ranges"))


def gate(files: DataFrame, diags: DataFrame, key: str = "file_id") -> DataFrame:
    """SNK-6: a file is indexed in strict mode only without any diagnostic; in
    lenient mode whenever it parsed."""
    n = diags.groupBy(key).agg(F.count(F.lit(1)).alias("n_messages"))
    return (files.select(key, "parse_ok").join(n, key, "left")
            .withColumn("n_messages", F.coalesce("n_messages", F.lit(0)).cast("bigint"))
            .select(key, "n_messages", (F.col("parse_ok") & (F.col("n_messages") == 0)).alias("indexed_strict"),
                    F.col("parse_ok").alias("indexed_lenient")))
