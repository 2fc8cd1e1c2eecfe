"""Helpers shared by the operators: table reads, Arrow slices and words as NumPy arrays.

Words are the runs matched by ``[^\\x20\\x09-\\x0D]+``.  They are found on the UTF-8
bytes of a whole slice of documents at once; no word crosses a document boundary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time (a longer document is a slice by itself).
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
_REMEMBERED: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Zero-copy slices of ``batch`` whose ``column`` holds about ``limit`` bytes each."""
    n = batch.num_rows
    if not n:
        return
    off = text_buffer(batch.column(column))[1]
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, side="right"))
        end = min(max(end - 1, at + 1), n, at + (1 << 16))
        yield batch.slice(at, end - at)
        at = end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows, from 0; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    if off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words of each document."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    word = ~_SPACE[buf]
    left = np.empty(n, bool)
    left[0], left[1:] = False, word[:-1]
    left[off[off < n]] = False
    starts = np.flatnonzero(word & ~left)
    right = np.empty(n, bool)
    right[-1], right[:-1] = False, word[1:]
    right[off[off > 0] - 1] = False
    ends = np.flatnonzero(word & ~right) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def powers(kind: str, n: int) -> np.ndarray:
    """Powers 0 to ``n`` of an odd base ("up") or of its inverse ("down"), modulo 2 ** 64."""
    have = _POWERS.get(kind)
    if have is None or len(have) <= n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 4 * SLICE_BYTES:
            _POWERS[kind] = have
    return have


def remembered(key: str, make):
    """What this worker process remembers under ``key``, made by ``make`` if it is new.  It
    remembers one thing: Spark gives a worker to one stage after another, and the tables of
    the stage before would stay beside the next one's."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _POWERS.clear()
        pa.default_memory_pool().release_unused()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans of ``buf``; equal bytes, equal hash."""
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers("up", n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * powers("down", n)[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; element i is for words i to i + k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for t in range(1, k):
        out = out * np.uint64(0xD1342543DE82EF95) + words[t:t + n]
    return mix(out)


def inside(counts: np.ndarray, k: int) -> np.ndarray:
    """For each word, whether the run of ``k`` words that it starts stays in its document
    (without the last ``k - 1`` words of all)."""
    total = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return (left >= k)[:max(0, total - k + 1)]


def word_count(column: str):
    """Number of words of a text as a Spark column; 0 for null."""
    body = F.btrim(F.col(column), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(body, F.lit("")) == "", F.lit(0).cast("long")).otherwise(
        F.size(F.split(body, r"[\x20\x09-\x0D]+")).cast("long"))


def code_points(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def sized(total: int, per_part: int, least: int = 1) -> int:
    """Parts for ``total`` units at ``per_part`` each."""
    return max(least, -(-int(total) // per_part))
