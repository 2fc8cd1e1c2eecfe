"""Statistics and scope groups kept up with an index pass (AGG-1 after SNK-2 / SNK-3).

A pass knows the rows that left and those that came.  Document frequencies, the number of
rows and the lengths change by their signed counts.  A scope group's stored first members
stay its first ones unless one of them left; only then, and only if the group had more
members than are stored, it is filled again from the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .search import GROUP_KEYS, first_members, scope_groups, scope_key
from .skew import shuffled
from .stats import term_stats


def signed_terms(came: DataFrame, left: DataFrame) -> DataFrame:
    """(field, term, df): by how much each document frequency changes."""
    both = term_stats(came).unionByName(term_stats(left).withColumn("df", -F.col("df")))
    return both.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df <> 0")


def merged_terms(old: DataFrame, delta: DataFrame) -> DataFrame:
    both = old.select("field", "term", "df").unionByName(delta.select("field", "term", "df"))
    return both.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")


def lengths(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and sum of their scope lengths."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.size("scope_path").cast("bigint"))).first()
    return n, total or 0


def merged_groups(old: DataFrame, came: DataFrame, left: DataFrame, old_members: DataFrame, index: DataFrame,
                  category: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(groups, members) after a pass.

    ``old``, ``old_members``: the stored ones, at least those of the names that ``came`` or
    ``left`` hold.  ``index``: all rows after the pass; read only for groups to be filled."""
    came = came.filter(F.col("category") == category)
    left = left.filter(F.col("category") == category)
    keyed = lambda rows: rows.withColumn("scope_key", scope_key())
    plus, few = scope_groups(came, category, limit)
    minus, _ = scope_groups(left, category, limit)
    counts = (old.select(*GROUP_KEYS, "scope_path", "n").unionByName(plus.select(*GROUP_KEYS, "scope_path", "n"))
              .unionByName(minus.select(*GROUP_KEYS, "scope_path", (-F.col("n")).alias("n")))
              .groupBy(*GROUP_KEYS).agg(F.sum("n").alias("n"), F.first("scope_path").alias("scope_path")).filter("n > 0"))
    at = ["file_id", "seq"]
    gone = keyed(left).select(*GROUP_KEYS, *at)
    lost = old_members.join(shuffled(gone), [*GROUP_KEYS, *at], "left_semi").select(*GROUP_KEYS).distinct()
    refill = materialize(lost.join(shuffled(old.filter(F.col("n") > limit)), GROUP_KEYS, "left_semi"), "groups-to-fill")
    kept = old_members.join(shuffled(gone), [*GROUP_KEYS, *at], "left_anti").join(shuffled(refill), GROUP_KEYS, "left_anti")
    parts = kept.unionByName(few.join(shuffled(refill), GROUP_KEYS, "left_anti").select(*kept.columns))
    if not refill.isEmpty():
        again = keyed(index.filter(F.col("category") == category)).join(shuffled(refill), GROUP_KEYS, "left_semi").drop("scope_path")
        parts = parts.unionByName(first_members(again, limit).select(*kept.columns))
    members = materialize(first_members(parts, limit), "group-members")
    tie = F.min(F.struct("file_id", "line", "start_col", "seq")).alias("first")
    return counts.join(shuffled(members.groupBy(*GROUP_KEYS).agg(tie)), GROUP_KEYS), members
