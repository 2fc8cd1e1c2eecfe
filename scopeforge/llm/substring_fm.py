"""Removal of word windows that an earlier document holds, by FM-indexes (operator 4).

1. ``anchors``: each window of 50 words selects its smallest 8-gram hash; equal windows
   select the same one.  Neighbouring windows with one selection are a segment of at most
   92 words, named by the 8-gram.  An 8-gram of one document alone cannot be a repeat.
2. Segments with equal words are one: all documents but its first lose it whole.
3. ``search``: the different segments of an 8-gram meet in one shard (by the 8-gram's
   hash).  A shard builds a compressed FM-index of its segments and streams each of them
   through it; backward search over the wavelet matrix gives matching statistics against
   earlier documents, and stretches of 50 words and more are reported.
   Segments of an 8-gram with more than ``HOT_SEGMENTS`` different ones are too many for
   a shard; their windows are compared one by one by a 128-bit hash, which spreads them.
4. ``deduplicate``: stretches are laid back on the documents.

An earlier document is one with a smaller id.  Null or empty text: no words.  Null ids:
the text is kept whole and removes nothing.  Rows that repeat an id are judged each by its
own text, and not against each other.  Only the named columns are read.  Empty table:
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeforge.session import materialize

from .common import gram_hashes, inside, mix, powers, sized, span_hashes, table, text_buffer, text_slices, words_of
from .fm_index import earlier_spans

WINDOW, GRAM = 50, 8
SHARD_SEGMENTS, HOT_SEGMENTS = 1_000, 8_000


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value of each run of ``width`` values."""
    place, span = np.arange(len(values)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while 2 * span <= width:
        place = better(place[:-span], place[span:])
        span *= 2
    rest = width - span
    return better(place[:-rest], place[rest:]) if rest else place


def word_hashes(column: pa.Array):
    buf, off = text_buffer(column)
    starts, ends, n = words_of(buf, off)
    return buf, starts, ends, n, span_hashes(buf, starts, ends)


def select(hashes: np.ndarray, n_words: np.ndarray):
    """Segments: (document, gram, first window, last window + 1, hash of the words), with
    windows as places among all words."""
    valid = inside(n_words, WINDOW)
    grams = gram_hashes(hashes, GRAM)
    if not valid.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.flatnonzero(valid)
    chosen = smallest(grams, WINDOW - GRAM + 1)[at]
    owner = np.repeat(np.arange(len(n_words)), n_words)[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    begin, end = at[first], at[last] + 1
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers("up", len(hashes))[:len(hashes)], out=total[1:])
    inverse = powers("down", len(hashes))
    words = (total[end + WINDOW - 1] - total[begin]) * inverse[begin]
    # segments are equal if their words and the place of the gram are
    seg = mix(words + mix((end - begin).astype(np.uint64) * np.uint64(131) + (chosen[first] - begin).astype(np.uint64)))
    return owner[first], grams[chosen[first]].view(np.int64), begin, end, seg.view(np.int64)


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_words, sha, gram, begin, end, seg): of each text its words, the hash
    of all words joined by spaces, and its segments as arrays."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                buf, starts, ends, n, hashes = word_hashes(part.column("text"))
                first = np.cumsum(n) - n
                owner, gram, begin, end, seg = select(hashes, n)
                if len(owner) and part.column("doc_id").null_count:
                    known = ~part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                    keep = known[owner]
                    owner, gram, begin, end, seg = (x[keep] for x in (owner, gram, begin, end, seg))
                off = pa.array(np.searchsorted(owner, np.arange(len(n) + 1)), pa.int32())
                base = first[owner]
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (
                    gram, (begin - base).astype(np.int32), (end - base).astype(np.int32), seg)]
                sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in
                       part.column("text").fill_null("").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(n.astype(np.int64)), pa.array(sha), *lists],
                    names=["doc_id", "th", "n_words", "sha", "gram", "begin", "end", "seg"])

    return docs.mapInArrow(run, f"doc_id {kind}, th long, n_words long, sha string, gram array<long>, "
                           "begin array<int>, end array<int>, seg array<long>")


def _shared(found: DataFrame) -> DataFrame:
    """(doc_id, th, gram, begin, end, seg, first, many): the segments whose gram stands in
    two documents or more, the first document of their words, and the number of different
    segments of the gram."""
    if not found.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", "th"])
    flat = found.select("doc_id", "th", F.explode(F.arrays_zip("gram", "begin", "end", "seg")).alias("s")).select(
        "doc_id", "th", "s.gram", "s.begin", "s.end", "s.seg")
    # the small sides are tables of their own, so that both sides of each join are plain
    # exchanges, whose hot partitions Spark splits
    grams = materialize(flat.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                        .filter("low < high").select("gram"), "fm-grams")
    rows = materialize(flat.join(grams, "gram"), "fm-shared")
    first = materialize(rows.groupBy("gram", "seg").agg(F.min("doc_id").alias("first")), "fm-first")
    many = materialize(first.groupBy("gram").agg(F.count("*").alias("many")), "fm-counts")
    return rows.join(materialize(first.join(many, "gram"), "fm-many"), ["gram", "seg"])


def _segments(holders: DataFrame) -> DataFrame:
    """(gram, seg, doc_id, words, windows): the texts of segments to be searched, each from
    its first document."""
    kind = holders.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = {"gram": [], "seg": [], "doc_id": [], "many": [], "words": []}
            for doc_id, text, spots in zip(batch.column("doc_id"), batch.column("text"), batch.column("spots")):
                words = None
                for s in spots.as_py():
                    if s["many"] > 1 and s["first"] == doc_id.as_py():
                        words = words if words is not None else text.as_py().encode().split()
                        out["gram"].append(s["gram"])
                        out["seg"].append(s["seg"])
                        out["doc_id"].append(doc_id.as_py())
                        out["many"].append(s["many"])
                        out["words"].append(b" ".join(words[s["begin"]:s["end"] + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["gram"], pa.int64()), pa.array(out["seg"], pa.int64()),
                 pa.array(out["doc_id"], batch.schema.field("doc_id").type), pa.array(out["many"], pa.int64()),
                 pa.array(out["words"], pa.binary())], names=["gram", "seg", "doc_id", "many", "words"])

    return holders.mapInArrow(run, f"gram long, seg long, doc_id {kind}, many long, words binary").dropDuplicates(
        ["gram", "seg"])


def _split(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of segment texts, and the number of words of each."""
    _, _, _, n, hashes = word_hashes(pa.chunked_array(column).combine_chunks().cast(pa.large_string())
                                     if not isinstance(column, pa.Array) else column.cast(pa.large_string()))
    return hashes, n


def _search_shard(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    hashes, lengths = _split(group["words"].combine_chunks())
    symbols = np.unique(hashes, return_inverse=True)[1] + 1
    owners = np.unique(group["doc_id"].to_numpy(), return_inverse=True)[1]
    which, begin, end = earlier_spans(symbols, lengths, owners, WINDOW)
    take = pa.array(which)
    return pa.table({"gram": group["gram"].take(take), "seg": group["seg"].take(take),
                     "x": pa.array(begin.astype(np.int32)), "y": pa.array(end.astype(np.int32))})


def _windows(batches):
    """Every window of hot segments by a 128-bit hash of its words."""
    for batch in batches:
        gram, seg, doc, at, key = [], [], [], [], []
        for g, s, d, words in zip(*(batch.column(c).to_pylist() for c in ("gram", "seg", "doc_id", "words"))):
            words = words.split()
            for i in range(len(words) - WINDOW + 1):
                gram.append(g)
                seg.append(s)
                doc.append(d)
                at.append(i)
                key.append(hashlib.blake2b(b" ".join(words[i:i + WINDOW]), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram, pa.int64()), pa.array(seg, pa.int64()), pa.array(doc, batch.schema.field("doc_id").type),
             pa.array(at, pa.int32()), pa.array(key, pa.binary())], names=["gram", "seg", "doc_id", "x", "key"])


def search(segments: DataFrame, shard_segments: int = SHARD_SEGMENTS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(gram, seg, x, y): stretches of words [x, y) of segments that an earlier document holds."""
    kind = segments.schema["doc_id"].dataType.simpleString()
    calm = segments.filter(F.col("many") <= hot_segments)
    shards = sized(calm.count(), shard_segments)
    by_index = (calm.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
                .groupBy("shard").applyInArrow(lambda group: _search_shard(group), "gram long, seg long, x int, y int"))
    hot = segments.filter(F.col("many") > hot_segments).select("gram", "seg", "doc_id", "words")
    windows = hot.mapInArrow(_windows, f"gram long, seg long, doc_id {kind}, x int, key binary")
    first = windows.groupBy("key").agg(F.min("doc_id").alias("first"))
    by_window = windows.join(first, "key").filter("first < doc_id").select(
        "gram", "seg", "x", (F.col("x") + WINDOW).alias("y"))
    return by_index.unionByName(by_window)


def deduplicate(docs: DataFrame, shard_segments: int = SHARD_SEGMENTS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, th, n_words, n_removed, kept_sha256, kept) of every row of ``docs``
    (doc_id, text).  ``th`` is xxhash64 of the text; ``kept`` is the text that is left,
    null where nothing was removed."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    found = materialize(anchors(docs), "fm-anchors")
    rows = materialize(_shared(found), "fm-segments")
    spots = rows.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("gram", "seg", "begin", "end", "first", "many")).alias("spots"))
    holders = materialize(docs.join(spots, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]), "fm-holders")
    segments = materialize(_segments(holders), "fm-texts")
    stretches = search(segments, shard_segments, hot_segments).groupBy("gram", "seg").agg(
        F.collect_list(F.struct("x", "y")).alias("spans"))
    own = rows.filter("doc_id = first").join(stretches, ["gram", "seg"]).select(
        "doc_id", "th", F.transform("spans", lambda s: F.struct(
            (F.col("begin") + s["x"]).alias("x"), (F.col("begin") + s["y"]).alias("y"))).alias("spans"))
    later = rows.filter("doc_id > first").select(
        "doc_id", "th", F.array(F.struct(F.col("begin").alias("x"), (F.col("end") + (WINDOW - 1)).alias("y"))).alias("spans"))
    spans = own.unionByName(later).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            removed, sha, kept = [], [], []
            for text, own_spans in zip(batch.column("text").to_pylist(), batch.column("spans")):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                flat = own_spans.values
                np.add.at(edge, flat.field("x").to_numpy(), 1)
                np.add.at(edge, flat.field("y").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(kept, pa.string())], names=["doc_id", "th", "n_removed", "kept_sha256", "kept"])

    changed = holders.select("doc_id", "th", "text").join(spans, ["doc_id", "th"]).mapInArrow(
        cut, f"doc_id {kind}, th long, n_removed long, kept_sha256 string, kept string")
    changed = materialize(changed, "fm-changed")
    same = found.select("doc_id", "th", "n_words", "sha").join(changed, ["doc_id", "th"], "left")
    return same.select("doc_id", "th", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                       F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")


def op4_fm_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
