"""Embedding whitening by weighted multiplicity covariance (operator 13).

1. ``integer_vectors``: vectors as integers, packed.  ``groupBy`` on the packed vector gives
   each distinct one and its count; a hot vector is one row per task before the shuffle.
2. Weights are the counts or one.  Their sum and the weighted sums of each dimension are
   exact integers.  Every task multiplies its centred vectors (a GEMM with the square roots
   of the weights); the products are added up by position.  Their number depends on the
   dimensions alone, so the matrix may go to the driver for its eigenvectors.
3. Each distinct vector is whitened once; the whitened covariance is taken again over them,
   for the error; then rows are joined to their vector.

Rows with a null vector or with null or non-finite entries are dropped; of vectors of
several lengths the most common one's (of those, the longest) are kept, and empty vectors are dropped.  Entries
beyond 2 ** 40 are clamped.  Null and repeated ids and rows are rows of their own.  Where
the fit has fewer dimensions than components (few or equal vectors), ``whitened`` of the rest is null and
their ``explained`` 0.  A deviation that a long cannot hold is null.  Only the named columns
are read.  Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeforge.session import materialize

from .common import table
from .vectors import matrix, packed, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
CLAMP = 1 << 40
#: Eigenvalues below this share of the largest are rounding.
RANK = 1e-12
#: Vectors that a task multiplies at a time.
ROWS = 4096


def integer_vectors(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): floor(scale * entry) + shift, eight bytes an entry."""
    def run(batches):
        for batch in batches:
            at, flat, offsets = usable(batch.column("embedding"))
            flat = np.floor(scale * np.where(np.isfinite(flat), flat, 0.0))
            values = np.clip(flat, -CLAMP, CLAMP).astype(np.int64) + shift
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), packed(values, offsets, at)],
                                             names=["vec_id", "x"])

    rows = materialize(rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
                       .mapInArrow(run, "vec_id long, x binary").filter("octet_length(x) > 0"), "whiten-rows")
    length = rows.groupBy(F.octet_length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    return rows.filter(F.octet_length("x") == (length["bytes"] if length else 0))


@dataclass(frozen=True)
class Fit:
    """Of a weighted list of integer vectors: number, sums, mean, covariance's eigenvectors."""
    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        return int((self.values > RANK * max(self.values.max(initial=0.0), 1e-300)).sum())


def _sums(distinct: DataFrame, width: int) -> tuple[int, list[int]]:
    """Sum of the weights and the weighted sums of each dimension, exactly."""
    def run(batches):
        for batch in batches:
            x, w = matrix(batch.column("x"), width), batch.column("weight").to_numpy()
            # two halves, so that no sum of a batch leaves 64 bits
            high, low = x >> 20, x & ((1 << 20) - 1)
            yield pa.RecordBatch.from_pydict({
                "d": pa.array(range(-1, width), pa.int32()),
                "high": np.concatenate([[0], w @ high]), "low": np.concatenate([[int(w.sum())], w @ low])})

    total = F.sum(F.col("high").cast("decimal(38,0)") * (1 << 20) + F.col("low").cast("decimal(38,0)"))
    found = distinct.mapInArrow(run, "d int, high long, low long").groupBy("d").agg(total.alias("s")).collect()
    sums = {r["d"]: int(r["s"]) for r in found}
    return sums.get(-1, 0), [sums.get(d, 0) for d in range(width)]


def _products(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of the tasks' matrices (i, row)."""
    found = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width, width))
    for r in found:
        out[r["i"], r["j"]] = r["v"]
    return out


def _gemm(batches, column, width: int):
    """The matrix that the batches' rows make with themselves, weighted, as rows (i, row)."""
    total = np.zeros((width, width))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            y = column(part) * np.sqrt(part.column("weight").to_numpy().astype(float))[:, None]
            total += y.T @ y
    yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                     names=["i", "row"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x minus the mean, with the difference taken in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """``distinct``: (x, weight)."""
    n, sums = _sums(distinct, width)
    if not n:
        return Fit(0, sums, np.zeros(width), np.zeros(0), np.zeros((width, 0)), 0.0)
    moments = distinct.mapInArrow(lambda b: _gemm(b, lambda p: centred(matrix(p.column("x"), width), n, sums), width),
                                  "i int, row array<double>")
    covariance = _products(moments, width) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, width)
    return Fit(n, sums, np.array([s / n for s in sums]), values[::-1][:k].copy(), vectors[:, ::-1][:, :k].copy(),
               float(np.trace(covariance)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Sum over dimensions of (n x - S) ** 2, exact; null beyond 64 bits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    off = x - whole
    most = n * (int(np.abs(off).max(initial=0)) + 1)
    if most * most * x.shape[1] < 1 << 63:
        own = n * off - rest
        return (own * own).sum(1).tolist()
    exact = [sum((n * int(o) - int(r)) ** 2 for o, r in zip(row, rest)) for row in off]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(rows: DataFrame, components: int = COMPONENTS, weights: str = "one", scale: int = SCALE,
           shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row.

    ``weights``: "one" fits on each distinct vector once, "counts" on every row."""
    x = integer_vectors(rows, scale, shift)
    weight = F.lit(1).cast("long") if weights == "one" else F.count("*")
    distinct = materialize(x.groupBy("x").agg(F.count("*").alias("copies"), weight.alias("weight")), "distinct-vectors")
    first = distinct.select(F.octet_length("x").alias("b")).first()
    width = (first["b"] if first else 8) // 8
    f = fit(distinct, width, components)
    k, rank = len(f.values), f.rank
    scales = np.zeros(k)
    scales[:rank] = 1 / np.sqrt(f.values[:rank])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own = matrix(part.column("x"), width)
                white = (centred(own, f.n, f.sums) @ f.vectors) * scales
                yield pa.RecordBatch.from_arrays(
                    [part.column("x"), part.column("weight"), pa.array(deviations(own, f.n, f.sums), pa.int64()),
                     pa.array(list(white), pa.list_(pa.float64()))], names=["x", "weight", "deviation", "whitened"])

    white = materialize(distinct.select("x", "weight").mapInArrow(
        run, "x binary, weight long, deviation long, whitened array<double>"), "whitened")
    values = lambda p: np.stack([np.asarray(v, float) for v in p.column("whitened").to_pylist()])
    moments = _products(white.mapInArrow(lambda b: _gemm(b, values, k), "i int, row array<double>"), k) / max(f.n, 1)
    error = float(np.abs(moments[:rank, :rank] - np.eye(rank)).max(initial=0.0))
    names = F.array(*[F.struct(F.lit(i + 1).alias("component"),
                               F.lit(float(f.values[i] / f.trace) if i < rank else 0.0).alias("explained"),
                               F.lit(i < rank).alias("known")) for i in range(k)]) if k else F.array().cast(
        "array<struct<component:int,explained:double,known:boolean>>")
    each = x.join(white.drop("weight"), "x").select("vec_id", "deviation", "whitened", F.posexplode(names).alias("i", "c"))
    return each.select("vec_id", "c.component", F.lit(f.n).cast("long").alias("n"), "deviation",
                       F.when(F.col("c.known"), F.get("whitened", F.col("i"))).alias("whitened"),
                       "c.explained", F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
