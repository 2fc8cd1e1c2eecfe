"""Mixing sources to target weights by a low-discrepancy schedule (operator 10).

* ``targets``: source sizes, weights by rank of the source name, and the water level
  that shares 150 % of all words without any source above twice its size.
* ``schedule``: slot k is the golden-ratio point frac((k + 1/2) phi) mapped through the
  cumulative targets; the slots of a source are ranked in slot order.
* ``blocks``: each source's documents in hash order, read twice in a row, cut into
  blocks of equal numbers of words.
* ``mix``: slot joined to block by (source, rank).

Nulls: a null text has 0 words and is never taken; a null source is a source of its
own, last in order; null or repeated ids keep their rows.  Empty table: empty result.
Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopeforge.session import materialize

from .common import sized, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Words of a block.
BLOCK_WORDS = 128
GOLDEN = 0.6180339887498949
_SLOT_RUN = 1 << 16
_ROWS_A_RUN = 20_000


def document_sizes(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """(rid, doc_id, source, size, h): the row's number (column ``rid``, or a new one) and
    the shuffled place of the document."""
    return docs.select(
        (F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), "doc_id", "source", word_count("text").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            epochs: int = EPOCHS) -> DataFrame:
    """(source, sid, weight, source_size, cap, target, lo, hi): one row per source.

    The windows run over one row per source.  ``lo`` and ``hi`` are the source's part of
    the unit interval."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("sid", F.row_number().over(name) - 1)
    pick = F.array(*[F.lit(w).cast("long") for w in weights])
    src = src.withColumn("weight", F.element_at(pick, (F.col("sid") % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * epochs)
    level = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    src = (src.withColumn("cap_below", F.coalesce(F.sum("cap").over(level), F.lit(0)))
           .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(level), F.lit(0)))
           .withColumn("wanted", F.sum("source_size").over(every) * F.lit(float(share))))
    # the level at which this source would be the first that is not full
    src = src.withColumn("rise", (F.col("wanted") - F.col("cap_below")) / F.col("weight_left"))
    # of all sources that would not be full, the first has the highest such level
    src = src.withColumn("water", F.max(F.when(F.col("rise") * F.col("weight") <= F.col("cap"), F.col("rise")))
                         .over(every))
    src = src.withColumn("target", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")))
    run = Window.orderBy("sid")
    src = (src.withColumn("hi", F.coalesce(F.try_divide(F.sum("target").over(run), F.sum("target").over(every)), F.lit(0.0)))
           .withColumn("lo", F.coalesce(F.lag("hi").over(run), F.lit(0.0))))
    # the last source ends the interval whatever the rounding of the sums
    last = F.max("sid").over(every)
    return src.withColumn("hi", F.when(F.col("sid") == last, F.lit(1.0)).otherwise(F.col("hi"))).select(
        "source", "sid", "weight", "source_size", "cap", "target", "lo", "hi")


def schedule(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, rank): slots 0 to ``slots`` - 1 dealt to sources by the golden ratio.

    The interval lookup is an equi-join on bins of the unit interval, about one source
    a bin; ranks are counted per run of slots, so no source is one task's work."""
    bins = 2 * sources.count() + 64
    spans = (sources.filter("hi > lo").select("sid", "lo", "hi")
             .withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * bins),
                                                     F.least(F.floor(F.col("hi") * bins), F.lit(bins - 1))))))
    x = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    points = (spark.range(slots).withColumn("u", x - F.floor(x))
              .withColumn("bin", F.least(F.floor(F.col("u") * bins), F.lit(bins - 1))))
    dealt = (points.join(spans, "bin").filter("u >= lo AND u < hi")
             .select(F.col("id").alias("slot"), "sid", F.floor(F.col("id") / _SLOT_RUN).alias("run")))
    before = (dealt.groupBy("sid", "run").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("sid").orderBy("run")) - F.col("count")).drop("count"))
    own = F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1
    return dealt.withColumn("own", own).join(before, ["sid", "run"]).select(
        "slot", "sid", (F.col("before") + F.col("own")).alias("rank"))


def blocks(sizes: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, epochs: int = EPOCHS,
           rows: int | None = None) -> DataFrame:
    """(rid, sid, epoch, block, from_word, words): the words of each document that lie in
    each block of its source.  Places are running sums in two steps, over runs of the
    shuffled order and inside a run, so a hot source is spread over tasks."""
    digits = len(f"{sized(sizes.count() if rows is None else rows, _ROWS_A_RUN):x}") + 1
    d = (sizes.filter("size > 0").join(F.broadcast(sources.select("source", "sid", "source_size"))
                                       if sources.count() <= 100_000 else
                                       sources.select("source", "sid", "source_size"),
                                       sizes["source"].eqNullSafe(sources["source"]))
         .select("rid", "sid", "size", "h", "source_size", F.substring("h", 1, digits).alias("run")))
    before = (d.groupBy("sid", "run").agg(F.sum("size").alias("run_size")).withColumn(
        "before", F.sum("run_size").over(Window.partitionBy("sid").orderBy("run")) - F.col("run_size"))
        .drop("run_size"))
    inner = Window.partitionBy("sid", "run").orderBy("h", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    d = (d.withColumn("upto", F.sum("size").over(inner)).join(before, ["sid", "run"])
         .withColumn("start", F.col("before") + F.col("upto") - F.col("size")))
    d = d.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    d = d.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start"))
    b = F.lit(block_words).cast("long")
    d = d.withColumn("block", F.explode(F.expr(
        f"sequence(at div {block_words}, (at + size - 1) div {block_words})")))
    first = F.greatest(F.col("at"), F.col("block") * b)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
    return d.select("rid", "sid", "epoch", "block", (first - F.col("at")).alias("from_word"),
                    (end - first).alias("words"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, rid: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, mixed); mixed: (slot, rid, sid, epoch, block, from_word, words),
    the pieces of documents in the order of the mix."""
    spark = docs.sparkSession
    sizes = materialize(document_sizes(docs, rid), "mix-sizes")
    sources = materialize(targets(sizes), "mix-sources")
    wanted = sources.agg(F.sum("target")).first()[0] or 0.0
    slots = schedule(spark, sources, int(-(-wanted // block_words)))
    pieces = blocks(sizes, sources, block_words)
    mixed = pieces.join(slots.withColumnRenamed("rank", "block"), ["sid", "block"])
    return sizes, sources, mixed.select("slot", "rid", "sid", "epoch", "block", "from_word", "words")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, sources, mixed = mix(table(spark, sf_dir, "documents"))
    taken = mixed.groupBy("rid").agg(F.sum("words").alias("taken"))
    src = sources.select(F.col("source").alias("s"), "source_size", "target")
    return (sizes.join(taken, "rid", "left").join(src, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0).cast("long")).alias("taken")))


#: The same schedule in SQL: per source, the slots won by it give the words taken from the
#: front of its shuffled stream of two epochs.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s0),
s2 AS (SELECT *, [5, 2, 1][(sid % 3 + 1)::INT]::BIGINT AS w, 2 * source_size AS cap FROM s1),
s3 AS (SELECT a.*, (SELECT coalesce(sum(b.cap), 0) FROM s2 b WHERE (b.cap / b.w, b.sid) < (a.cap / a.w, a.sid)) AS below,
              (SELECT sum(b.w) FROM s2 b WHERE (b.cap / b.w, b.sid) >= (a.cap / a.w, a.sid)) AS w_left,
              (SELECT sum(source_size) FROM s2) * 1.5::DOUBLE AS wanted FROM s2 a),
s4 AS (SELECT *, (wanted - below)::DOUBLE / w_left::DOUBLE AS rise FROM s3),
l AS (SELECT a.rise AS level, sum(least(b.cap::DOUBLE, a.rise * b.w)) AS held, any_value(a.wanted) AS wanted
      FROM s4 a, s4 b GROUP BY a.sid, a.rise),
s5 AS (SELECT *, least(cap::DOUBLE, (SELECT arg_min(level, abs(held - wanted)) FROM l) * w) AS target FROM s4),
s6 AS (SELECT *, sum(target) OVER (ORDER BY sid) / (SELECT sum(target) FROM s5) AS hi0 FROM s5),
s7 AS (SELECT *, CASE WHEN sid = (SELECT max(sid) FROM s6) THEN 1.0 ELSE hi0 END AS hi,
              coalesce(lag(hi0) OVER (ORDER BY sid), 0.0) AS lo FROM s6),
k AS (SELECT unnest(range(ceil((SELECT sum(target) FROM s5) / {BLOCK_WORDS}.0)::BIGINT)) AS k),
u AS (SELECT (k + 0.5::DOUBLE) * {GOLDEN}::DOUBLE - floor((k + 0.5::DOUBLE) * {GOLDEN}::DOUBLE) AS u FROM k),
n AS (SELECT sid, count(*) * {BLOCK_WORDS} AS words FROM u JOIN s7 ON u >= lo AND u < hi GROUP BY sid),
p AS (SELECT d.*, s7.source_size, s7.target, coalesce(n.words, 0) AS words,
             sum(size) OVER (PARTITION BY s7.sid ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source LEFT JOIN n ON n.sid = s7.sid)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, words - start)) + greatest(0, least(size, words - source_size - start)))::BIGINT AS taken
FROM p
"""
