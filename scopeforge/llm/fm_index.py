"""A compressed full-text index of word sequences: Burrows-Wheeler transform in a wavelet
matrix, with the smallest owner of any range of suffixes.  All searches of a shard run side
by side as array operations.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` symbols at least (prefix doubling)."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.uint64)
    step = 1
    while True:
        key = rank << np.uint64(32)
        key[:n - step] |= rank[step:] + np.uint64(1)
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.uint64)
        np.cumsum(key[order][1:] != key[order][:-1], out=new[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = new
        step *= 2
        if step >= depth or int(new[-1]) == n - 1:
            return order


class WaveletMatrix:
    """Rank of any symbol in any prefix, one bit vector a level with counts per word."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        n = len(symbols)
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(-n % 64 + 64, bool)), bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            zeros = n - int(bit.sum())
            self.levels.append((shift, packed, before, zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places on the lowest level; of two places of a symbol the difference counts it."""
        for shift, packed, before, zeros in self.levels:
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1)))
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at


class RangeMinimum:
    """Smallest value of any range, by tables of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2
        self.flat = np.concatenate(self.rows)
        self.base = np.cumsum([0] + [len(r) for r in self.rows[:-1]])

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - begin
        level = np.frexp(size.astype(float))[1] - 1
        base = self.base[level]
        return np.minimum(self.flat[base + begin], self.flat[base + end - (1 << level)])


class FMIndex:
    """Index of sequences (``symbols`` from 1, cut by ``lengths``), each with an owner.

    The text is the reversed sequences with a 0 behind each, so a backward search extends
    a match to the right of the sequences."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, owners: np.ndarray):
        n = len(symbols) + len(lengths)
        ends = np.cumsum(lengths + 1)
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        start = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(lengths)), lengths)
        text[inside] = symbols[start[owner] + lengths[owner] - 1 - (np.arange(len(symbols)) - start[owner])]
        self.size = int(symbols.max()) + 1 if len(symbols) else 1
        order = suffix_order(text, int(lengths.max()) + 2)
        self.wavelet = WaveletMatrix(text[order - 1], self.size)
        self.below = np.searchsorted(text[order], np.arange(self.size))
        self.zero = self.wavelet.ranks(np.arange(self.size), np.zeros(self.size, np.int64))
        whose = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.minimum = RangeMinimum(owners[whose[order]])
        self.n = n

    def extend(self, symbol: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of matches with one more symbol."""
        both = self.wavelet.ranks(np.concatenate([symbol, symbol]), np.concatenate([begin, end]))
        base = np.concatenate([self.below[symbol] - self.zero[symbol]] * 2)
        both += base
        return both[:len(begin)], both[len(begin):]


def earlier_spans(symbols: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int):
    """(sequence, begin, end) of every maximal stretch of at least ``window`` symbols that
    some sequence of a smaller owner holds too.

    Matching statistics: for each end the earliest begin whose stretch an earlier owner
    has; both only move forward.  When a match cannot take its next symbol, the earliest
    begin that can is found by halving, each probe being a backward search."""
    index = FMIndex(symbols, lengths, owners)
    start = np.cumsum(lengths) - lengths
    lane = np.flatnonzero(lengths >= window)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    begin, at = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    probing = np.zeros(len(lane), bool)
    low, high, goal = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    sp, ep = np.zeros(len(lane), np.int64), np.full(len(lane), index.n)
    while len(lane):
        a, b = index.extend(symbols[start[lane] + at], sp, ep)
        ok = b > a
        ok[ok] = index.minimum.least(a[ok], b[ok]) < owners[lane[ok]]
        size, limit = lengths[lane], lengths[lane] - window
        sp, ep = np.where(ok, a, sp), np.where(ok, b, ep)
        at = at + ok
        done = np.zeros(len(lane), bool)
        # a match that ends: by the next symbol or by the sequence's end
        stop = ~probing & (~ok | (at == size))
        long = stop & (at - begin >= window)
        if long.any():
            found.append((lane[long], begin[long], at[long]))
        done |= stop & ok
        fail = stop & ~ok
        low = np.where(fail, np.maximum(begin + 1, at - window + 1), low)
        high = np.where(fail, np.minimum(limit, at) + 1, high)
        goal = np.where(fail, at, goal)
        # probes: [middle, goal] was found, or was not
        reached = probing & ok & (at > goal)
        missed = probing & ~ok
        high = np.where(reached, begin, high)
        low = np.where(missed, begin + 1, low)
        again = fail | reached | missed
        settled = again & (low >= high)
        done |= settled & (low > limit)
        probing = (probing | fail) & ~settled
        begin = np.where(settled, low, np.where(again, (low + high) // 2, begin))
        at = np.where(again, begin, at)
        sp, ep = np.where(again, 0, sp), np.where(again, index.n, ep)
        if done.any():
            keep = ~done
            lane, begin, at, probing, low, high, goal, sp, ep = (
                x[keep] for x in (lane, begin, at, probing, low, high, goal, sp, ep))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))
