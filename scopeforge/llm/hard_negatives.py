"""Hard negatives by angular triangle filtering (operator 11).

1. ``prepared``: integer vectors, their norms, and their angles to a few reference
   directions, stored.  The references are spread over a bounded sample of rows; they
   decide how much is skipped, never what is found.
2. Rows are dealt to blocks by their nearest reference, large ones by hash as well;
   anchors likewise.  Of two vectors with angles a and b to a reference, the angle between
   them lies in [|a - b|, min(a + b, 2 pi - a - b)].  Cosines of these limits times both
   norms, widened beyond any rounding, bound the score.
3. ``positives``: the first same-label rows of each anchor.  What an anchor finds in its own
   block is a lower limit for the rest; pairs of blocks, and inside them windows of stored
   angles, that cannot reach it are not scored.
4. ``negatives``: each positive asks for scores in a window; only rows whose bounds overlap
   an anchor's windows are scored, in integers.

Rows without label, without vector, or with null or non-finite components take no part.
Null ids are no anchors and come last among ties.  Repeated rows and ids are rows of their
own; an anchor is not its own positive, but a copy of it is.  Vectors of unequal length:
missing components are 0.  Components whose scores a long could not hold are clamped.  Only
the named columns are read.  Empty table, or one without anchors: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopeforge.session import materialize

from .common import table
from .vectors import matrix, packed, usable

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score, in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Reference directions, and the rows that they are chosen from.
REFERENCES, SAMPLE = 32, 1024
#: References that an anchor's rows are tried against one by one: those it is nearest to or farthest from.
TRIED = 4
#: Rows of a block (at least and at most), and anchors that meet it at a time.
BLOCK_ROWS, BLOCK_ANCHORS = (512, 8192), 2048
#: Radians beyond the rounding of two stored angles.
SLACK = 2e-6

PAIR = ["a_block", "r_block"]


def _angles(vectors: np.ndarray, norm: np.ndarray, references: np.ndarray) -> np.ndarray:
    cosine = vectors.astype(float) @ references.T / np.where(norm > 0, norm, 1.0)[:, None]
    return np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def integer_rows(rows: DataFrame, label, anchor, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(rid, vec_id, label, anchor, vec) of the rows that take part, and the vectors' length."""
    length = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, length)
    limit = math.isqrt((1 << 62) // width)

    def run(batches):
        for batch in batches:
            at, flat, offsets = usable(batch.column("embedding"))
            values = np.clip(np.floor(scale * np.where(np.isfinite(flat), flat, 0.0)), -limit, limit).astype(np.int64)
            own = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [own.column(c) for c in ("rid", "vec_id", "label", "anchor")] + [packed(values, offsets, at)],
                names=["rid", "vec_id", "label", "anchor", "vec"])

    found = rows.filter("label IS NOT NULL AND embedding IS NOT NULL").select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), label.cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding"))
    return materialize(found.mapInArrow(run, "rid long, vec_id long, label long, anchor boolean, vec binary"),
                       "integer-vectors"), width


def references(rows: DataFrame, width: int) -> np.ndarray:
    """Unit directions, each the farthest from those before, among ``SAMPLE`` rows."""
    some = rows.select("vec").orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).toArrow()
    vectors = matrix(some["vec"], width).astype(float)
    norm = np.linalg.norm(vectors, axis=1)
    vectors = vectors[norm > 0] / norm[norm > 0][:, None]
    if not len(vectors):
        return np.eye(1, width)
    chosen, nearest = [0], vectors @ vectors[0]
    while len(chosen) < min(REFERENCES, len(vectors)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, vectors @ vectors[far])
    return vectors[chosen]


def prepared(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """``rows`` with norm, angles (packed floats) and the nearest reference as ``cell``."""
    width = refs.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = matrix(part.column("vec"), width)
                norm = np.linalg.norm(vectors.astype(float), axis=1)
                angle = _angles(vectors, norm, refs)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(norm), pa.array([a.tobytes() for a in angle], pa.binary()),
                     pa.array(angle.argmin(1).astype(np.int32))], names=[*part.schema.names, "norm", "angles", "cell"])

    return materialize(rows.mapInArrow(run, rows.schema.simpleString()[len("struct<"):-1].replace(":", " ")
                                       + ", norm double, angles binary, cell int"), "angles")


def _blocks(counts: dict[int, int], cells: int, size: int):
    """Column of the block of a row: small cells share one, large cells have several."""
    first, parts, at, room = [0] * cells, [1] * cells, -1, 0
    for cell in range(cells):
        n = counts.get(cell, 0)
        if n > size:
            first[cell], parts[cell] = at + 1, -(-n // size)
            at, room = at + parts[cell], 0
        else:
            if n > room:
                at, room = at + 1, size
            first[cell], room = max(at, 0), room - n
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    return (pick(first) + F.pmod(F.xxhash64("rid"), pick(parts))).cast("int"), at + 1


class Block:
    """Rows in order of their angle to the reference that is nearest to most of them."""

    def __init__(self, rows: pa.Table, width: int):
        angle = np.stack([np.frombuffer(a, np.float32) for a in rows["angles"].to_pylist()])
        self.main = int(np.bincount(angle.argmin(1)).argmax())
        order = np.argsort(angle[:, self.main], kind="stable")
        self.angle = np.ascontiguousarray(angle[order].T)
        rows = rows.take(pa.array(order))
        self.vectors = matrix(rows["vec"], width)
        self.most = int(np.abs(self.vectors).max())
        self.real = self.vectors.astype(float)
        self.norm, self.rid, self.label = (rows[c].to_numpy() for c in ("norm", "rid", "label"))
        ids = rows["vec_id"]
        self.no_id = ids.is_null().to_numpy()
        self.vec_id = ids.fill_null(0).to_numpy()

    def overlap(self, norm: float, angle: np.ndarray, low: float, high: float) -> np.ndarray:
        """Places of the rows whose score bounds meet [low, high]."""
        reach = norm * self.norm.max()
        widest = math.acos(min(1.0, max(-1.0, (low - 1) / reach))) if reach > 0 and low > 0 else math.pi
        a, b = np.searchsorted(self.angle[self.main], [angle[self.main] - widest - SLACK, angle[self.main] + widest + SLACK])
        gap, far = np.zeros(b - a), np.full(b - a, math.pi)
        for r in np.argsort(-np.abs(angle - math.pi / 2))[:TRIED]:
            other = self.angle[r, a:b]
            both = angle[r] + other.astype(float)
            np.maximum(gap, np.abs(angle[r] - other), out=gap)
            np.minimum(far, np.minimum(both, 2 * math.pi - both), out=far)
        top = norm * self.norm[a:b]
        pad = 1 + 1e-9 * top
        upper = top * np.cos(np.maximum(gap - SLACK, 0)) + pad
        lower = top * np.cos(np.minimum(far + SLACK, math.pi)) - pad
        return a + np.flatnonzero((upper >= low) & (lower <= high))

    def scores(self, at: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Integer inner products, through doubles where these hold every sum exactly."""
        if len(vector) * self.most * int(np.abs(vector).max()) < 1 << 53:
            return (self.real[at] @ vector.astype(float)).astype(np.int64)
        return self.vectors[at] @ vector

    def first(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` of ``at`` by falling score, then id."""
        own = np.arange(len(at))
        if len(at) > 4 * k:
            own = np.flatnonzero(score >= np.partition(score, -k)[-k])
        on = at[own]
        return own[np.lexsort((self.rid[on], self.vec_id[on], self.no_id[on], -score[own]))[:k]]

    def ids(self, at: np.ndarray) -> list:
        return [None if none else int(i) for i, none in zip(self.vec_id[at], self.no_id[at])]


def first_positives(anchors: pa.Table, rows: pa.Table, width: int, k: int) -> pa.Table:
    """(rid, positive_id, score, other) of the first ``k`` of each anchor in a block of rows."""
    out = {"rid": [], "positive_id": [], "score": [], "other": []}
    if anchors.num_rows and rows.num_rows:
        block = Block(rows, width)
        vectors = matrix(anchors["vec"], width)
        for i, a in enumerate(anchors.select(["rid", "label", "norm", "angles", "low"]).to_pylist()):
            low = -math.inf if a["low"] is None else a["low"]
            at = block.overlap(a["norm"], np.frombuffer(a["angles"], np.float32), low, math.inf)
            at = at[(block.label[at] == a["label"]) & (block.rid[at] != a["rid"])]
            score = block.scores(at, vectors[i])
            own = block.first(at, score, k)
            out["rid"] += [a["rid"]] * len(own)
            out["positive_id"] += block.ids(at[own])
            out["score"] += score[own].tolist()
            out["other"] += block.rid[at[own]].tolist()
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def first_negatives(anchors: pa.Table, rows: pa.Table, width: int, k: int, least: int, most: int) -> pa.Table:
    """(rid, p, negative_id, score, other): the first ``k`` rows of a block for each positive
    ``p`` of each anchor."""
    out = {"rid": [], "p": [], "negative_id": [], "score": [], "other": []}
    if anchors.num_rows and rows.num_rows:
        block = Block(rows, width)
        vectors = matrix(anchors["vec"], width)
        for i, a in enumerate(anchors.select(["rid", "label", "norm", "angles", "windows"]).to_pylist()):
            windows = [(w["p"], *window(w["score"], least, most)) for w in a["windows"]]
            at = block.overlap(a["norm"], np.frombuffer(a["angles"], np.float32),
                               min(w[1] for w in windows), max(w[2] for w in windows))
            at = at[block.label[at] != a["label"]]
            score = block.scores(at, vectors[i])
            for p, low, high in windows:
                own = np.flatnonzero((score >= low) & (score <= high))
                own = own[block.first(at[own], score[own], k)]
                out["rid"] += [a["rid"]] * len(own)
                out["p"] += [p] * len(own)
                out["negative_id"] += block.ids(at[own])
                out["score"] += score[own].tolist()
                out["other"] += block.rid[at[own]].tolist()
    return pa.table({c: pa.array(v, pa.int32() if c == "p" else pa.int64()) for c, v in out.items()})


def _unlimited(anchors: pa.Table) -> pa.Table:
    return anchors.append_column("low", pa.nulls(anchors.num_rows, pa.int64()))


def window(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """Least and greatest integer s with least * score <= 100 * s <= most * score."""
    return -(-(least * score) // 100), (most * score) // 100


def block_ranges(rows: DataFrame, block: str) -> DataFrame:
    """(block, low, high, norm): the range of the angles to each reference, the largest norm."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            angle = np.stack([np.frombuffer(a, np.float32) for a in batch.column("angles").to_pylist()])
            norm, own = batch.column("norm").to_numpy(), batch.column(block).to_numpy()
            for b in np.unique(own):
                in_b = own == b
                low, high = angle[in_b].min(0), angle[in_b].max(0)
                yield pa.RecordBatch.from_pydict({
                    block: pa.array([b] * len(low), pa.int32()), "r": pa.array(range(len(low)), pa.int32()),
                    "low": low.astype(float), "high": high.astype(float), "norm": [float(norm[in_b].max())] * len(low)})

    parts = rows.select(block, "angles", "norm").mapInArrow(run, f"{block} int, r int, low double, high double, norm double")
    of = parts.groupBy(block, "r").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"))
    of = of.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("r", "low", "high"))).alias("f"), F.max("norm").alias("norm"))
    return of.select(block, F.col("f.low").alias(f"{block}_low"), F.col("f.high").alias(f"{block}_high"),
                     F.col("norm").alias(f"{block}_norm"))


def block_pairs(anchors: DataFrame, row_ranges: DataFrame, n_rows: int) -> DataFrame:
    """(a_block, r_block) that may hold a pair within reach.  ``anchors`` have ``low``, the
    least score of interest (null: any)."""
    need = anchors.groupBy("a_block").agg(F.min(F.when(F.col("norm") > 0, F.coalesce("low", F.lit(-1)) / F.col("norm")))
                                          .alias("need"))
    mine = block_ranges(anchors, "a_block").join(need, "a_block").withColumn(
        "r_block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    gaps = F.zip_with(F.zip_with("a_block_low", "r_block_high", lambda x, y: x - y),
                      F.zip_with("r_block_low", "a_block_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    cosine = F.col("need") / F.col("r_block_norm") - 1e-9
    widest = F.when((F.col("need") > 0) & (cosine > 0), F.acos(F.least(cosine, F.lit(1.0)))).otherwise(math.pi)
    return materialize(mine.join(row_ranges, "r_block").filter(F.array_max(gaps) <= widest + 4 * SLACK).select(*PAIR),
                       "negative-pairs")


def mine(rows: DataFrame, label, anchor, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = rows.sparkSession
    whole, width = integer_rows(rows, label, anchor, scale)
    refs = references(whole, width)
    whole = prepared(whole, refs)
    sizes = {r["cell"]: r for r in whole.groupBy("cell").agg(
        F.count("*").alias("n"), F.count_if("anchor").alias("a")).collect()}  # one row a reference
    n = sum(r["n"] for r in sizes.values())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(max(-(-n // tasks), BLOCK_ROWS[0]), BLOCK_ROWS[1])
    r_block, n_rows = _blocks({c: r["n"] for c, r in sizes.items()}, len(refs), size)
    a_block, _ = _blocks({c: r["a"] for c, r in sizes.items()}, len(refs), BLOCK_ANCHORS)
    if not n:
        r_block = a_block = F.lit(0)
    blocks = materialize(whole.withColumn("r_block", r_block), "negative-blocks")
    anchors = blocks.filter("anchor").withColumn("a_block", a_block)
    ranges = materialize(block_ranges(blocks, "r_block"), "negative-ranges")

    found = "rid long, positive_id long, score long, other long"
    first = blocks.groupBy("r_block").applyInArrow(lambda t: first_positives(
        _unlimited(t.filter(t["anchor"])), t, width, positives), found)
    low = first.groupBy("rid").agg(F.when(F.count("*") >= positives, F.min("score")).alias("low"))
    anchors = materialize(anchors.drop("r_block").join(low, "rid", "left"), "negative-anchors")

    def meet(mine: DataFrame, work, schema: str) -> DataFrame:
        pairs = block_pairs(mine, ranges, n_rows)
        left, right = mine.join(pairs, "a_block"), blocks.select(
            "r_block", "rid", "vec_id", "label", "vec", "norm", "angles").join(pairs, "r_block")
        return left.groupBy(*PAIR).cogroup(right.groupBy(*PAIR)).applyInArrow(work, schema)

    def firsts(found: DataFrame, keys: list[str], of: str, k: int, rank: str) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(of).asc_nulls_last(), "other")
        return found.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) <= k)

    good = meet(anchors, lambda a, r: first_positives(a, r, width, positives), found)
    good = materialize(firsts(good, ["rid"], "positive_id", positives, "p"), "positives")
    windows = good.filter("score >= 0").groupBy("rid").agg(  # a negative score has no window
        F.array_sort(F.collect_list(F.struct("p", "score"))).alias("windows"),
        F.ceil(F.min("score") * least / 100).alias("low"))
    asking = materialize(anchors.drop("low").join(windows, "rid"), "negative-windows")
    bad = meet(asking, lambda a, r: first_negatives(a, r, width, negatives, least, most),
               "rid long, p int, negative_id long, score long, other long")
    bad = firsts(bad, ["rid", "p"], "negative_id", negatives, "rank")
    return (bad.withColumnRenamed("score", "negative_score").drop("other")
            .join(good.withColumnRenamed("score", "positive_score").drop("other"), ["rid", "p"])
            .join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op11_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM part a JOIN part b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
