"""I-Match fingerprints with randomised lexicons (operator 7).

The lexicon holds the terms (lower-cased words) that stand in two documents at least and
whose share of documents lies in a band.
Every subset of it keeps a term by a hash of the term and the subset's number, at rates
from dense to sparse.  A fingerprint has one 32-bit hash per subset, of the distinct terms
of the text that the subset keeps, in sorted order; a sparse subset misses small edits, so
the share of equal parts tells how much of the in-band vocabulary two texts have in
common.  A text without in-band terms is hashed by all its distinct terms.

The band's lower edge bounds the lexicon: at most (mean distinct terms of a document) /
``LOW`` terms, whatever the number of documents.  Where that mean passes ``LOW * MAX_LEXICON``
the edge rises, so that no more than ``MAX_LEXICON`` terms are broadcast: likeness is then
told by commoner terms only.

The next document is the next row by descending id (ids in buckets between exact
boundaries; the row behind a boundary is copied into the bucket before it).  Null text:
empty text.  Null ids come last; rows of equal id are ordered by text.  Only the named
columns are read.  Empty table: empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeforge.session import materialize

from .common import lower_ascii, mix, sized, span_hashes, table, text_buffer, text_slices, words_of

#: Band of the share of documents that hold a term.
LOW, HIGH = 0.0005, 0.2
#: Share of the lexicon that each subset keeps.
RATES = tuple(2.0 ** -(3 + k / 10) for k in range(64))
#: Most terms of a lexicon (40 MB): beyond a mean of 2,500 distinct terms a document the lower edge rises.
MAX_LEXICON = 5_000_000
BUCKET_ROWS, MAX_BUCKETS = 1_000, 5_000
_EMPTY = 0


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit term hashes of each text, sorted, and how many each has (at most
    65,536 texts: the text's number takes the upper bits of the sort key)."""
    buf = lower_ascii(buf)
    starts, ends, n = words_of(buf, off)
    owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = np.sort(owner << np.uint64(48) | span_hashes(buf, starts, ends) >> np.uint64(16))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key & np.uint64((1 << 48) - 1), np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=len(n))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many documents each term stands; counted per batch first."""
    def run(batches):
        for batch in batches:
            found = [_terms(*text_buffer(p.column(text)))[0] for p in text_slices(batch, text)]
            if found:
                term, df = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch({"term": pa.array(term.view(np.int64)), "df": pa.array(df.astype(np.int64))})

    return docs.select(text).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, most: int = MAX_LEXICON) -> np.ndarray:
    """Sorted hashes of the terms whose share of all documents is in [low, high].

    The shares of all terms add up to the mean number of distinct terms, so at most that
    mean / low terms reach the lower edge; the edge is raised where this bound would pass
    ``most``."""
    df = materialize(document_frequencies(docs).filter("df > 1"), "imatch-df")
    total = docs.count()
    mean = (df.agg(F.sum("df")).first()[0] or 0) / max(1, total)
    low = max(low, mean / most)
    rows = df.filter(F.col("df").between(low * total, high * total)).select("term").toArrow()
    return np.sort(rows.column("term").to_numpy().view(np.uint64))


class Subsets:
    """Which subsets keep which lexicon term, and the fingerprints of texts."""

    def __init__(self, terms: np.ndarray, rates: tuple[float, ...] = RATES):
        self.terms, self.rates = terms, rates
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[terms & np.uint64((1 << 22) - 1)] = True
        # term -> list of subsets, as flat arrays
        keep = [np.flatnonzero(mix(terms + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) <
                               np.uint64(int(r * 2.0 ** 64))) for k, r in enumerate(rates)]
        place = np.concatenate([np.zeros(0, np.int64), *keep])
        number = np.repeat(np.arange(len(rates)), [len(x) for x in keep])
        order = np.argsort(place, kind="stable")
        self.subset = number[order]
        self.first = np.searchsorted(place[order], np.arange(len(terms) + 1))

    def fingerprints(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One row of 32-bit hashes per text."""
        words, n = _terms(buf, off)
        owner = np.repeat(np.arange(len(n)), n)
        near = np.flatnonzero(self.maybe[words & np.uint64((1 << 22) - 1)]) if len(self.terms) else np.zeros(0, np.int64)
        place = np.searchsorted(self.terms, words[near])
        hit = place < len(self.terms)
        near, place = near[hit], place[hit]
        hit = self.terms[place] == words[near] if len(place) else np.zeros(0, bool)
        near, place = near[hit], place[hit]
        count = self.first[place + 1] - self.first[place]
        at = np.repeat(self.first[place] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        # the terms of a text come sorted, so an order-free sum of spread hashes is the hash of the sorted list
        sums = np.zeros((len(n), len(self.rates)), np.uint64)
        spread = mix(words[near] + np.uint64(0x5851F42D4C957F2D))
        np.add.at(sums, (np.repeat(owner[near], count), self.subset[at]), np.repeat(spread, count))
        out = (mix(sums) >> np.uint64(32)).astype(np.uint32)
        out[sums == 0] = _EMPTY
        bare = np.bincount(owner[near], minlength=len(n)) == 0
        if bare.any():
            whole = np.zeros(len(n), np.uint64)
            np.add.at(whole, owner, mix(words + np.uint64(0x14057B7EF767814F)))
            out[bare] = (mix(whole[bare, None] + np.arange(1, len(self.rates) + 1, dtype=np.uint64))
                         >> np.uint64(32)).astype(np.uint32)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal parts among those that either text fills; 1 for equal fingerprints."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    equal = ((a == b) & filled).sum(1)
    total = filled.sum(1)
    return np.where(total == 0, 1.0, equal / np.maximum(total, 1))


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u4")]


def boundaries(docs: DataFrame, id_column: str, rows: int = BUCKET_ROWS) -> np.ndarray:
    """Ids that cut the table into at most ``MAX_BUCKETS`` buckets of about ``rows`` rows."""
    n = min(MAX_BUCKETS, sized(docs.count(), rows))
    if n == 1:
        return np.zeros(0)
    return np.unique(docs.approxQuantile(id_column, [k / n for k in range(1, n)], 0.3 / n))


def fingerprint_pairs(docs: DataFrame, terms: np.ndarray, id_column: str = "doc_id", text: str = "text",
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Ids are numbers.  Bucket b holds the ids of [cut b - 1, cut b); the last row of a
    bucket in descending order is followed by the largest id of the bucket below, which
    is copied in; below the lowest bucket comes the largest id of all."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    docs = docs.select(F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    cuts = boundaries(docs, "id", bucket_rows)

    def bucketed(batches):
        for batch in batches:
            ids = batch.column("id").to_pandas().to_numpy(float, na_value=-np.inf)
            bucket = np.searchsorted(cuts, ids, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], names=[*batch.schema.names, "bucket"])

    rows = docs.mapInArrow(bucketed, f"id {kind}, text string, bucket int")
    tops = (docs.select("id").mapInArrow(bucketed, f"id {kind}, bucket int")
            .groupBy("bucket").agg(F.max("id").alias("top")).orderBy("bucket").collect())  # a row per bucket
    # the first row of a bucket is the next one of the last row of the bucket above, the highest's of the lowest's
    head = spark.createDataFrame([(r["bucket"], r["top"], tops[(i + 1) % len(tops)]["bucket"])
                                  for i, r in enumerate(tops)], f"bucket int, top {kind}, above int")
    lead = (rows.join(F.broadcast(head), "bucket").filter(F.col("id").eqNullSafe(F.col("top")))
            .groupBy("above", "id").agg(F.min("text").alias("text")))
    copied = lead.select("id", "text", F.col("above").alias("bucket"), F.lit(1).alias("copy"))
    both = rows.select("id", "text", "bucket", F.lit(0).alias("copy")).unionByName(copied)
    terms_b = spark.sparkContext.broadcast(terms)

    def run(batches):
        subsets = Subsets(terms_b.value)
        held = None  # the row that waits for its next one

        def finish(ids, texts, nexts, prints, next_prints):
            n = [len(t) for t in texts]
            edited = [t[:k - k // 2] + x[:k // 2] for t, x, k in zip(texts, nexts, n)]
            column = pa.array(edited, pa.large_string())
            ep = subsets.fingerprints(*text_buffer(column))
            return pa.record_batch({
                "id": ids, "n_chars": pa.array(n, pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                "fingerprint": pa.array(_hex(prints)), "edited_fingerprint": pa.array(_hex(ep)),
                "near_edited": pa.array(likeness(prints, ep)), "near_next": pa.array(likeness(prints, next_prints))})

        for batch in batches:
            for part in text_slices(batch, "text"):
                fp = subsets.fingerprints(*text_buffer(part.column("text")))
                rows = list(zip(part.column("bucket").to_pylist(), part.column("copy").to_pylist(),
                                part.column("id").to_pylist(), part.column("text").to_pylist(), fp))
                if held is not None:
                    rows.insert(0, held)
                done = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
                held = rows[-1]
                if done:
                    yield finish(pa.array([a[2] for a, _ in done], part.schema.field("id").type),
                                 [a[3] for a, _ in done], [b[3] for _, b in done],
                                 np.array([a[4] for a, _ in done]), np.array([b[4] for _, b in done]))

    ordered = (both.repartition("bucket").sortWithinPartitions(
        "bucket", "copy", F.col("id").desc_nulls_last(), "text"))
    return ordered.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                              "edited_fingerprint string, near_edited double, near_next double"
                              ).withColumnRenamed("id", id_column)


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprint_pairs(docs, lexicon(docs))
