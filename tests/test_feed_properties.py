"""Properties of index maintenance and the live feed."""

import uuid

from pyspark.sql import functions as F

from scopeforge.session import shared_dir
from scopeforge.sinks.index import replace_files
from scopeforge.sources import fixtures as fx
from scopeforge.streaming import feed as FD
from scopeforge.streaming import live as LV

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replace_twice_equals_replace_once(spark):
    f = FD.events_feed(fx.table(spark, SF, "events"))
    old = FD.text_tokens(FD.latest_text_agg(f.filter(F.col("version") % 2 == 0)))
    changed = FD.latest_text_agg(f.filter(F.col("version") % 2 == 1))
    new_rows = FD.text_tokens(changed)
    once = replace_files(old, new_rows, changed)
    twice = replace_files(once, new_rows, changed)
    assert _rows(once) == _rows(twice)


def test_periodic_trigger_reaches_batch_state(spark):
    feed = FD.events_feed(fx.table(spark, SF, "events"))
    path = f"{shared_dir(spark)}/test-feeds/{uuid.uuid4().hex[:12]}"
    LV.write_feed_files(feed, path, files=4)
    state = f"{shared_dir(spark)}/test-state/{uuid.uuid4().hex[:12]}"
    q = LV.replay(spark, path, lambda df, e: LV.merge_latest(spark, df, state, FD.REINDEX_EVENTS, 4),
                  "periodic-test", trigger_seconds=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = _rows(spark.read.parquet(state).select("file_id", "version", "text"))
    want = _rows(FD.latest_text(feed).select("file_id", "version", "text"))
    assert got == want and len(got) > 0


def test_bucket_overwrite_replace_keeps_index_equal(spark):
    from scopeforge.session import materialize
    from scopeforge.sinks.index import bucket_of, overwrite_buckets, write_symbols
    docs = fx.table(spark, SF, "documents")
    path = f"{shared_dir(spark)}/test-index/{uuid.uuid4().hex[:12]}"
    write_symbols(fx.document_symbols(spark, docs), path, buckets=4)
    before = _rows(spark.read.parquet(path))
    changed_docs = docs.filter(F.col("lang") == "de")        # re-extract one language's files
    changed = changed_docs.select(F.col("doc_id").alias("file_id"))
    touched = F.broadcast(changed.select(bucket_of("file_id", 4).alias("bucket")).distinct())
    old = spark.read.parquet(path).join(touched, "bucket").drop("bucket")
    merged = materialize(replace_files(old, fx.document_symbols(spark, changed_docs), changed))
    overwrite_buckets(merged, path, 4)
    after = spark.read.parquet(path)
    assert _rows(after.select(*spark.read.parquet(path).columns)) == before


def test_pass_that_empties_buckets_equals_a_rebuild(spark):
    """Deleted files are gone although their buckets hold nothing else, and the number of
    buckets is the index's own, not the session's."""
    from scopeforge.sinks.index import bucket_count, replace_in_index, write_symbols
    docs = fx.table(spark, SF, "documents").filter("doc_id < 6")
    path = f"{shared_dir(spark)}/test-index/{uuid.uuid4().hex[:12]}"
    write_symbols(fx.document_symbols(spark, docs), path, buckets=64)
    assert bucket_count(spark, path) == 64
    changed, deleted = docs.filter("doc_id = 2"), docs.filter("doc_id in (3, 5)")
    key = F.col("doc_id").alias("file_id")
    replace_in_index(path, fx.document_symbols(spark, changed), changed.select(key), deleted.select(key))
    left = spark.read.parquet(path)
    want = fx.document_symbols(spark, docs.filter("doc_id not in (3, 5)"))
    assert _rows(left.select(*want.columns)) == _rows(want)
