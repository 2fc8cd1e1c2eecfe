"""SimHash near duplicates by pivot distance tables (operator 12).

1. ``fingerprints``: 64 bits of each text, a bit being the majority of that bit over the
   XXH64 of its word shingles.  Equal fingerprints are one node from here on.
2. The distance table holds the Hamming distances of every fingerprint to many reference
   fingerprints.  Two fingerprints at most ``r`` bits apart differ by at most ``r`` in every
   coordinate.  A tree of cuts of single coordinates deals the fingerprints to cells: at a
   cut, those below go left, the others right, and those above it by less than ``r`` also
   left as guests, so that each close pair meets in exactly one cell where one of them, at
   least, is at home.  The tree is drawn from a bounded sample; it decides the sizes of
   cells, never what is found.  A cell that is large on all data is met as pairs of blocks.
3. In a task, coordinate by coordinate, groups that differ by more than ``r`` are dropped;
   surviving pairs are verified on the fingerprints.  A task returns a spanning forest.
4. components over the forests.

Null, empty and wordless texts: fingerprint zero, linked like any other.  Repeated rows and
ids are kept as rows; an id's component is that of its row's fingerprint.  Null ids never
name a component.  Only the named columns are read.  Empty table: empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeforge.session import materialize

from .common import table, text_slices
from .components import connected, forest

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Reference fingerprints, and the fingerprints that they and the cuts are chosen from.
PIVOTS, SAMPLE = 32, 65_536
#: Fingerprints at home in a cell (at least and at most), and of a block of a larger cell.
CELL, BLOCK = (4096, 131_072), 131_072
#: A cut is made while it leaves at most this share of the pairs; sample rows of a cell.
WORTH, LEAST_SAMPLE = 0.9, 32
#: Pairs that are compared at once, and hashes that are counted at once.
PAIRS_AT_ONCE, HASHES_AT_ONCE = 1 << 21, 1 << 17
#: Products of group sizes that are not cut further.
SMALL = 1 << 15


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of ``text`` (UTF-8), repeats included."""
    words = text.lower().split()  # bytes: only A-Z, and exactly the six blanks
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - k + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    line = b" ".join(words)
    spans = (line[a:b] for a, b in zip(starts, ends[len(words) - n:].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), np.uint64, n)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.zeros((len(sizes), 64), np.int64)
    for at in range(0, len(flat), HASHES_AT_ONCE):
        part, own = flat[at:at + HASHES_AT_ONCE], owner[at:at + HASHES_AT_ONCE]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text)."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                found = majority([shingle_hashes(t or b"", k) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def distances(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distance table: a row for each fingerprint, a column for each pivot."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :])


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Fingerprints of the sample, each the farthest from those before and their complements."""
    few = sample[:4096]
    if not len(few):
        return np.zeros(1, np.uint64)
    chosen = [few[0]]
    off = np.full(len(few), 64, np.int64)
    while len(chosen) < min(n, len(few)):
        d = np.bitwise_count(few ^ chosen[-1]).astype(np.int64)
        np.minimum(off, np.minimum(d, 64 - d), out=off)
        far = int(off.argmax())
        if off[far] <= 0:
            break
        chosen.append(few[far])
    return np.array(chosen, np.uint64)


def draw_tree(table: np.ndarray, share: float, radius: int = RADIUS) -> list:
    """Nodes (pivot, cut, left, right) or (cell,): the cut of a node is the one that leaves
    the fewest pairs.  Cells hold about ``share`` of the rows of ``table``."""
    nodes: list = []
    least = max(LEAST_SAMPLE, share * len(table))
    cells = 0

    def grow(own: np.ndarray) -> int:
        nonlocal cells
        at = len(nodes)
        nodes.append(None)
        best = None
        if len(own) > least:
            for pivot in range(own.shape[1]):
                n = np.bincount(own[:, pivot], minlength=66 + radius).astype(float)
                below = np.concatenate([[0], np.cumsum(n)])
                cut = np.arange(1, 65)
                left, right = below[cut], len(own) - below[cut]
                cost = left * left / 2 + right * right / 2 + left * (below[cut + radius] - below[cut])
                cost[(left == 0) | (right == 0)] = np.inf
                c = int(cost.argmin())
                if best is None or cost[c] < best[0]:
                    best = cost[c], pivot, int(cut[c])
        if best is None or best[0] > WORTH * len(own) ** 2 / 2:
            nodes[at] = (cells,)
            cells += 1
        else:
            low = own[:, best[1]] < best[2]
            left = grow(own[low])
            nodes[at] = (best[1], best[2], left, grow(own[~low]))
        return at

    grow(table)
    return nodes


def deal(nodes: list, table: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): the cells of each row of a distance table."""
    out = []

    def go(at: int, home: np.ndarray, guest: np.ndarray) -> None:
        if not len(home) + len(guest):
            return
        node = nodes[at]
        if len(node) == 1:
            rows = np.concatenate([home, guest])
            out.append((rows, np.full(len(rows), node[0]), np.arange(len(rows)) < len(home)))
            return
        pivot, cut, left, right = node
        dh, dg = table[home, pivot].astype(int), table[guest, pivot].astype(int)
        near = home[(dh >= cut) & (dh < cut + radius)]
        go(left, home[dh < cut], np.concatenate([guest[dg < cut + radius], near]))
        go(right, home[dh >= cut], guest[dg >= cut - radius])

    go(0, np.arange(len(table)), np.zeros(0, np.int64))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(part) for part in zip(*out))


def cells_of(prints: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(cell, fp, table, home) of distinct fingerprints (fp), with their distances."""
    spark = prints.sparkSession
    some = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow()["fp"].to_numpy().view(np.uint64)
    pivots = choose_pivots(some)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(max(n // (2 * tasks), CELL[0]), CELL[1])
    nodes = draw_tree(distances(some, pivots), size / max(1, n), radius)

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            own = distances(fp, pivots)
            row, cell, home = deal(nodes, own, radius)
            for at in range(0, len(row), 1 << 16):
                r = row[at:at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({
                    "cell": pa.array(cell[at:at + (1 << 16)], pa.int32()), "fp": pa.array(fp[r].view(np.int64)),
                    "distances": pa.array([d.tobytes() for d in own[r]], pa.binary()), "home": pa.array(home[at:at + (1 << 16)])})

    return prints.select("fp").mapInArrow(run, "cell int, fp long, distances binary, home boolean")


class ClosePairs:
    """A spanning forest of the close pairs that are found so far."""

    def __init__(self, fp: np.ndarray, table: np.ndarray, radius: int = RADIUS):
        self.fp, self.radius = fp, radius
        spread = np.argsort(-table.astype(np.float32).var(0), kind="stable") if len(table) else np.arange(table.shape[1])
        self.table = np.ascontiguousarray(table[:, spread].T).astype(np.int16)
        self.a, self.b, self.held = [], [], 0

    def join(self, a: np.ndarray, b: np.ndarray | None, depth: int = 0) -> None:
        """Pairs of ``a`` with ``b``, or of ``a`` with itself."""
        if not len(a) or b is not None and not len(b):
            return
        if depth == len(self.table) or len(a) * len(a if b is None else b) <= SMALL:
            return self.verify(a, b, depth)
        at = self.table[depth]
        a = a[np.argsort(at[a], kind="stable")]
        da = at[a]
        cuts = np.flatnonzero(np.concatenate([[True], da[1:] != da[:-1], [True]]))
        if b is not None:
            b = b[np.argsort(at[b], kind="stable")]
            db = at[b]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own, d = a[lo:hi], int(da[lo])
            if b is None:
                self.join(own, None, depth + 1)
                self.join(own, a[hi:np.searchsorted(da, d + self.radius, side="right")], depth + 1)
            else:
                self.join(own, b[np.searchsorted(db, d - self.radius):np.searchsorted(db, d + self.radius, side="right")], depth + 1)

    def verify(self, a: np.ndarray, b: np.ndarray | None, depth: int) -> None:
        other = a if b is None else b
        step = max(1, PAIRS_AT_ONCE // len(other))
        for lo in range(0, len(a), step):
            part = a[lo:lo + step]
            near = np.bitwise_count(self.fp[part][:, None] ^ self.fp[other][None, :]) <= self.radius
            i, j = np.nonzero(near)
            x, y = part[i], other[j]
            differ = x != y
            self.a.append(x[differ])
            self.b.append(y[differ])
            self.held += int(differ.sum())
            if self.held > PAIRS_AT_ONCE:
                self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray]:
        """(smallest, other): the forest so far."""
        if self.held:
            node, label = forest(np.concatenate(self.a), np.concatenate(self.b))
            other = node != label
            self.a, self.b, self.held = [label[other]], [node[other]], 0
        return (self.a[0], self.b[0]) if self.a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(prints: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): spanning forests of the links between ``n`` distinct fingerprints (fp)."""
    cells = materialize(cells_of(prints, n, radius), "pivot-cells")
    sizes = materialize(cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cell-sizes")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = cells.join(sizes, "cell").withColumn("own", own).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "with"), F.greatest("own", "with")
    members = members.select("cell", lo.alias("lo"), hi.alias("hi"), (F.col("own") == lo).alias("first"), "fp", "distances", "home")

    def run(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy().view(np.uint64)
        own = np.stack([np.frombuffer(d, np.uint8) for d in group["distances"].to_pylist()])
        home, first = group["home"].to_numpy(), group["first"].to_numpy()
        pairs = ClosePairs(fp, own, radius)
        if group["lo"][0] == group["hi"][0]:
            pairs.join(np.flatnonzero(home), None)
            pairs.join(np.flatnonzero(home), np.flatnonzero(~home))
        else:  # two blocks of a large cell: only pairs across
            pairs.join(np.flatnonzero(home & first), np.flatnonzero(~first))
            pairs.join(np.flatnonzero(home & ~first), np.flatnonzero(~home & first))
        a, b = pairs.shrink()
        return pa.table({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    return members.groupBy("cell", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text)."""
    rows = materialize(fingerprints(docs, k), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    labels = connected(materialize(links(prints, prints.count(), radius), "fingerprint-links"))
    named = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = materialize(named, "fingerprint-labels")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_print = materialize(named.select("fp", "label").join(smallest, "label").select("fp", "component_id"), "fingerprint-components")
    return rows.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
