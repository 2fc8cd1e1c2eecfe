"""Index statistics behind the relevance score (AGG-1).

``term_stats``: document frequency per (field, term) for the two scored fields,
``scope`` (names of the scope path, counted once per symbol) and ``node_type``.
``field_stats``: number of indexed symbols and mean scope length.  Both are plain
grouped aggregations with map-side partial aggregation, so a hot term is
pre-aggregated on every executor before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import BM25_B, BM25_K1


def term_stats(symbols: DataFrame) -> DataFrame:
    # the symbols of a scope share its path: terms are taken from each different path once
    paths = symbols.groupBy("scope_path", "node_type").agg(F.count(F.lit(1)).alias("n"))
    terms = F.concat(
        F.transform(F.array_distinct("scope_path"), lambda t: F.struct(F.lit("scope").alias("field"), t.alias("term"))),
        F.array(F.struct(F.lit("node_type").alias("field"), F.col("node_type").alias("term"))))
    return (paths.select("n", F.explode(terms).alias("t"))
            .groupBy(F.col("t.field").alias("field"), F.col("t.term").alias("term"))
            .agg(F.sum("n").alias("df")))


def field_stats(symbols: DataFrame) -> DataFrame:
    return symbols.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg(F.size("scope_path").cast("double")).alias("avg_len")).select(
        F.lit("scope").alias("field"), "n_docs", "avg_len")


@dataclass(frozen=True)
class ScoreStats:
    """Scalars of the score plus the term table with its idf column."""
    n_docs: int
    avg_len: float
    terms: DataFrame          # field, term, df, idf

    def length_norm(self, scope_len: Column) -> Column:
        """BM25 factor of a scope term for a symbol with ``scope_len`` names (tf = 1)."""
        avg = self.avg_len if self.avg_len > 0 else 1.0
        return F.lit(1.0 + BM25_K1) / (
            F.lit(1.0) + F.lit(BM25_K1) * (F.lit(1.0 - BM25_B) + F.lit(BM25_B) * scope_len.cast("double") / F.lit(avg)))


def idf(df_col: Column, n_docs: int) -> Column:
    n = F.lit(float(n_docs))
    return F.log(F.lit(1.0) + (n - df_col + F.lit(0.5)) / (df_col + F.lit(0.5)))


def score_stats(symbols: DataFrame) -> ScoreStats:
    """Compute the statistics once per index version.  Only two scalars reach the
    driver; the term table stays distributed."""
    row = field_stats(symbols).first()
    n_docs, avg_len = int(row["n_docs"]), float(row["avg_len"] or 0.0)
    terms = term_stats(symbols).withColumn("idf", idf(F.col("df"), n_docs))
    return ScoreStats(n_docs, avg_len, terms)
