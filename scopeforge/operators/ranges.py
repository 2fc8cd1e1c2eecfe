"""Range, interval and ordering primitives (J-1, J-6, J-7, EXT-12).

Spark has no native range join: after the equi keys it would compare every pair
inside a key group, and one large file (or line) would become one quadratic
task.  Both joins here add a *bin* to the equi key: the interval side is
replicated into every fixed-width block it touches, the point side falls into
exactly one block, so each matching pair is produced exactly once and a group
never exceeds one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .skew import shuffled

#: Rows of packed offsets that are looked up, and go out as one batch.
LOCATED_ROWS = 256


def bins(lo: Column, hi: Column, block: int) -> Column:
    """Blocks touched by [lo, hi]; empty for reversed ranges."""
    b = F.lit(block)
    return F.when(hi >= lo, F.sequence(F.floor(lo / b), F.floor(hi / b))).otherwise(
        F.array().cast("array<bigint>"))


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], point: str,
               lo: str, hi: str, how: str = "inner", block: int = 256,
               extra: Column | None = None) -> DataFrame:
    """Points joined to the ranges that cover them: ``lo <= point <= hi`` (both ends
    closed) on equal ``keys``.  Column names of the two sides must be distinct
    except for ``keys``."""
    r = ranges.withColumn("_bin", F.explode(bins(F.col(lo), F.col(hi), block))).alias("_r")
    p = points.withColumn("_bin", F.floor(F.col(point) / F.lit(block))).alias("_p")
    P = lambda c: F.col(f"_p.`{c}`")
    R = lambda c: F.col(f"_r.`{c}`")
    c = P("_bin") == R("_bin")
    for k in keys:
        c = c & (P(k) == R(k))
    c = c & (P(point) >= R(lo)) & (P(point) <= R(hi))
    if extra is not None:
        c = c & extra
    out = p.join(shuffled(r), c, how)
    return out.select(*[P(k).alias(k) for k in keys],
                      *[P(x).alias(x) for x in points.columns if x not in keys],
                      *[R(x).alias(x) for x in ranges.columns if x not in keys])


def interval_contains(points: DataFrame, intervals: DataFrame, key: str, point_lo: str,
                      point_hi: str, lo: str, hi: str, strict: bool, block: int) -> DataFrame:
    """Pairs (node, interval) with the node's [point_lo, point_hi] inside
    [lo, hi] (strictly, or with equal ends allowed) on equal ``key`` (J-7)."""
    iv = intervals.withColumn("_bin", F.explode(bins(F.col(lo), F.col(hi), block))).alias("_i")
    p = points.withColumn("_bin", F.floor(F.col(point_lo) / F.lit(block))).alias("_p")
    P = lambda c: F.col(f"_p.`{c}`")
    I = lambda c: F.col(f"_i.`{c}`")  # noqa: E731,E741
    if strict:
        inside = (I(lo) < P(point_lo)) & (P(point_hi) < I(hi))
    else:
        inside = (I(lo) <= P(point_lo)) & (P(point_hi) <= I(hi))
    out = p.join(shuffled(iv), (P(key) == I(key)) & (P("_bin") == I("_bin")) & inside, "inner")
    return out.select(P(key).alias(key), *[P(x).alias(x) for x in points.columns if x != key],
                      *[I(x).alias(x) for x in intervals.columns if x != key])


def asof_lines(offsets: DataFrame, lines: DataFrame, key: str, offset: str = "off",
               block: int = 256, packed: bool = True, how: str = "inner", with_end: bool = False) -> DataFrame:
    """FN-7 / J-6: offset -> (line, column) with an as-of join on the line starts.

    ``lines`` (key, line, line_start, line_len): the line covering an offset is the one
    with ``line_start <= off <= line_start + line_len`` (the newline itself belongs to
    its line).  Offsets and lines meet by blocks of ``block`` characters, a few lines long.
    Before the shuffle the offsets of a block that are side by side become one row, in which
    an offset takes its place in the block only; behind it the lines of a block are one row,
    and the offsets of many blocks are looked up at once in their sorted starts.  Each offset
    matches exactly one line (of lines that overlap, each that covers it).  Not ``packed``:
    offsets of which few are side by side are shuffled one by one; then with ``how`` "left" those
    without a line are kept, and ``with_end`` gives the line's last offset as ``_line_end``.
    """
    if not packed:
        ln = lines.select(key, "line", "line_start", (F.col("line_start") + F.col("line_len")).alias("_line_end"))
        j = range_join(offsets, ln, [key], offset, "line_start", "_line_end", how, block)
        j = j.withColumn("col", F.col(offset) - F.col("line_start"))
        return j if with_end else j.drop("_line_end")
    rest = [c for c in offsets.columns if c not in (key, offset)]
    own = offsets.filter(F.col(key).isNotNull() & F.col(offset).isNotNull()).select(key, F.col(offset).cast("bigint").alias(offset), *rest)
    small = "binary" if block <= 256 else "array<int>"
    types = dict(own.dtypes)
    rows = own.mapInArrow(partial(_packed, block), f"`{key}` {types[key]}, _bin bigint, _low {small}" + "".join(
        f", `{c}` array<{types[c]}>" for c in rest))
    ln = lines.select(key, F.col("line").cast("bigint").alias("line"), F.col("line_start").cast("bigint").alias("line_start"),
                      (F.col("line_start") + F.col("line_len")).cast("bigint").alias("_line_end"))
    ln = ln.withColumn("_bin", F.explode(bins(F.col("line_start"), F.col("_line_end"), block)))
    ln = ln.groupBy(key, "_bin").agg(F.sort_array(F.collect_list(F.struct("line_start", "_line_end", "line"))).alias("_lines"))
    both = rows.join(shuffled(ln), [key, "_bin"]).select(
        key, "_bin", "_low", *rest, *[F.col(f"_lines.{c}").alias(f"_{n}") for n, c in enumerate(["line_start", "_line_end", "line"])])
    found = both.mapInArrow(partial(_located, block), f"`{key}` {types[key]}, `{offset}` bigint" + "".join(
        f", `{c}` {types[c]}" for c in rest) + ", line bigint, line_start bigint")
    out = found.select(key, *[c for c in offsets.columns if c != key], "line", "line_start")
    return out.withColumn("col", F.col(offset) - F.col("line_start"))


def _packed(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, offset, ...) as (key, block, places in it, lists of the other columns): a row for
    rows of a batch that are side by side and in one block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, off = batch.column(0), batch.column(1).to_numpy()
        bin_ = off // block
        new = np.ones(len(off), bool)
        new[1:] = bin_[1:] != bin_[:-1]
        new[1:] |= pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, len(off) - 1)), True).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        cuts = pa.array(np.append(first, len(off)), pa.int32())
        low = off - bin_ * block
        if block <= 256:
            lows = pa.Array.from_buffers(pa.binary(), len(first), [None, cuts.buffers()[1], pa.py_buffer(low.astype(np.uint8))])
        else:
            lows = pa.ListArray.from_arrays(cuts, pa.array(low, pa.int32()))
        rest = [pa.ListArray.from_arrays(cuts, c) for c in batch.columns[2:]]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(first)), pa.array(bin_[first]), lows, *rest],
                                         [batch.schema.names[0], "_bin", "_low", *batch.schema.names[2:]])


def _located(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The offsets of (key, block, places, lists, starts, ends and numbers of lines) with their line."""
    for whole in batches:
        names = whole.schema.names
        for at in range(0, whole.num_rows, LOCATED_ROWS):
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in whole.slice(at, LOCATED_ROWS).columns], names)
            keys, bin_, low = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            starts, ends, numbers = batch.columns[-3:]
            cuts = _cuts(low)
            if block <= 256:
                raw = low.buffers()[2]
                low = np.frombuffer(raw, np.uint8, cuts[-1] if raw is not None else 0)[cuts[0]:] if raw is not None else np.zeros(0, np.uint8)
            else:
                low = low.flatten().to_numpy()
            group = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            off = bin_[group] * block + low
            line_cuts = _cuts(starts)
            of = np.repeat(np.arange(batch.num_rows), np.diff(line_cuts))
            starts, ends = starts.flatten().to_numpy(), ends.flatten().to_numpy()
            # sorted by row and by start in the row's block
            place = of * (block + 1) + np.clip(starts - bin_[of] * block, 0, block)
            hit = np.searchsorted(place, group * (block + 1) + low, "right") - 1
            mine = np.flatnonzero((hit >= 0) & (of[np.maximum(hit, 0)] == group) & (ends[np.maximum(hit, 0)] >= off)) if len(of) else np.zeros(0, int)
            hit = hit[mine]
            same = of[1:] == of[:-1]
            if (same & (starts[1:] <= ends[:-1])).any():    # lines that overlap: all pairs of a row
                pairs = [(a + i, b + j) for g in range(batch.num_rows) for a, b in [(cuts[g] - cuts[0], line_cuts[g] - line_cuts[0])]
                         for i, o in enumerate(off[a:cuts[g + 1] - cuts[0]]) for j in range(line_cuts[g + 1] - line_cuts[g])
                         if starts[b + j] <= o <= ends[b + j]]
                mine, hit = (np.array(x, int) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(group[mine])), pa.array(off[mine]), *[c.flatten().take(pa.array(mine)) for c in batch.columns[3:-3]],
                 numbers.flatten().take(pa.array(hit)), pa.array(starts[hit])],
                [names[0], "_off", *names[3:-3], "line", "line_start"])


def _cuts(lists: pa.Array) -> np.ndarray:
    """Where each list (or binary value) of an array begins, and the end."""
    return np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1 + lists.offset)[lists.offset:]


def sequence_in_group(df: DataFrame, keys: list[str], block_of: str, order: list[Column],
                      out: str = "seq", block: int = 65_536, reach: DataFrame | None = None) -> DataFrame:
    """Dense 0-based sequence number within ``keys`` by ``order`` (EXT-12).

    A plain ``row_number() OVER (PARTITION BY keys)`` sorts a whole group in one
    task, and one file may hold a third of all rows.  Here the group is cut into
    blocks of the integer column ``block_of`` (which must be monotone with the
    order): rows are numbered inside (keys, block) and shifted by the row count of
    all earlier blocks.  Block counts are pre-aggregated, so only one small row per
    block crosses the second window; where no group goes beyond block 0, none are made.
    A plain ``df`` is read first for that; for one of a long plan, ``reach`` (keys,
    block_of) tells it: it has rows beyond block 0 if ``df`` has.
    """
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])

    def blocked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_blk", F.when(unknown, 0).otherwise(F.floor(F.col(block_of) / F.lit(block))))

    several = not blocked(df if reach is None else reach).filter(F.col("_blk").isNull() | (F.col("_blk") != 0)).isEmpty()
    d = blocked(materialize(df, "numbered-rows") if several and reach is not None else df)
    inner = Window.partitionBy(*keys, "_blk").orderBy(*order)
    numbered = d.withColumn("_rn", F.row_number().over(inner) - 1)
    if not several:
        return numbered.withColumn(out, F.col("_rn").cast("bigint")).drop("_blk", "_rn")
    counts = d.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (numbered.join(shuffled(offsets), [*keys, "_blk"], "left")
            .withColumn(out, (F.coalesce("_off", F.lit(0)) + F.col("_rn")).cast("bigint"))
            .drop("_blk", "_rn", "_off"))
