"""Plans that keep what grows with the input out of the driver and out of one task."""

from pyspark.sql import functions as F

from scopeforge.operators import extract as X
from scopeforge.plans import extract_queries as EQ
from scopeforge.session import materialize
from scopeforge.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_broadcasts_rules_only(spark):
    """Node tables of a few MB are millions of rows: they are shuffled, not sent to the driver."""
    nodes = materialize(fx.program_nodes(spark, SF)[0], "test-nodes")
    assert "Broadcast" not in _plan(X.qualifier_chain(nodes)) + _plan(X._parents(nodes, "file_id"))
    roots = nodes.filter("kind = 'Send'").select("file_id", "pre", "post", F.lit(True).alias("self_included"))
    assert "Broadcast" not in _plan(X.prune_subtrees(nodes, roots))
    assert _plan(EQ.q_extract_symbols(spark, SF)).count("BroadcastHashJoin") == 0
    # nation, region, the methods and the macro rules
    assert _plan(fx.call_tree_nodes(spark, SF)).count("BroadcastExchange") <= 3


def test_index_shuffles_texts_and_not_their_symbols(spark, tmp_path, monkeypatch):
    """A bucket of much text is several tasks; rows are sorted where they are made."""
    from scopeforge.sinks import index as I
    docs = fx.table(spark, SF, "documents").select("doc_id", "lang", "source", "text")
    monkeypatch.setattr(I, "TASK_TEXT", 20_000)
    dealt = I.deal_by_bucket(docs, "doc_id", "text", 2)
    used = dealt.select(I.bucket_of("doc_id", 2).alias("b"), F.spark_partition_id().alias("p")).distinct()
    assert min(r["count"] for r in used.groupBy("b").count().collect()) > 3
    rows = fx.document_symbols(spark, dealt, dealt=True)
    assert _plan(rows).count("Exchange") == 2          # the texts, and the broadcast rules
    I.write_symbols(rows, str(tmp_path / "i"), 2, dealt=True)
    found, plain = spark.read.parquet(str(tmp_path / "i")), fx.document_symbols(spark, docs)
    assert found.count() == plain.count()
    assert found.select(*plain.columns).exceptAll(plain).isEmpty()
    assert found.filter(F.col("bucket") != I.bucket_of("file_id", 2)).isEmpty()


def test_index_sorts_texts_and_takes_terms_from_different_paths(spark):
    """Symbols are neither sorted nor summed over in their rows; the terms of a scope path are taken once."""
    from scopeforge.operators.stats import term_stats
    from scopeforge.sinks import index as I
    docs = fx.table(spark, SF, "documents").select("doc_id", "lang", "source", "text")
    dealt = I.deal_by_bucket(docs, "doc_id", "text", 2, 3)
    for part in dealt.select(I.bucket_of("doc_id", 2).alias("b"), "doc_id").rdd.glom().collect():
        assert part == sorted(part)
    rows = fx.document_symbols(spark, dealt, dealt=True)
    assert "aggregate(" not in _plan(rows)
    plan = _plan(term_stats(rows))
    assert plan.count("HashAggregate") == 4 and plan.index("Generate explode") < plan.rindex("keys=[scope_path")


def test_search_drops_rows_of_other_files_before_the_shuffle(spark):
    from scopeforge.operators import search as S
    from scopeforge.plans.index import bucketed_index
    index, buckets = bucketed_index(spark, SF)
    files = spark.createDataFrame([(50,), (100,)], "file_id long")
    cut = S.of_files(index, files, buckets)
    assert sorted(r[0] for r in cut.select("file_id").distinct().collect()) == [50, 100]


def test_pages_are_written_by_several_tasks(spark, tmp_path):
    """One small file of pages is one split; its pages are dealt out before they are written."""
    import glob
    import re
    fx.write_page_tree(spark, SF, str(tmp_path / "tree"))
    names = glob.glob(str(tmp_path / "tree/app/src/page=*/part-*.txt"))
    pages = fx.table(spark, SF, "pages").filter("page_id % 8 IN (0, 1, 2)").count()
    assert len(names) == pages
    assert len({re.search(r"part-(\d+)", n)[1] for n in names}) > 1


def test_nodes_of_frames_and_pruned_subtrees_make_no_pairs(spark):
    """A node is shuffled once; nodes and roots of one file are not compared pair by pair."""
    rng = __import__("random").Random(5)
    spans = [(f, a, a + rng.randrange(0, 40), rng.random() < 0.5) for f in (1, 2) for a in rng.sample(range(400), 60)]
    roots = spark.createDataFrame(spans, "file_id long, pre long, post long, self_included boolean")
    rows = [(f, a, a + rng.randrange(0, 5), f"n{a}") for f in (1, 2, 3) for a in range(0, 400, 3)]
    nodes = spark.createDataFrame([*rows, (None, 5, 6, "none")], "file_id long, pre long, post long, name string")
    for block in (16, 1 << 20):
        kept = X.prune_subtrees(nodes, roots, block=block)
        inside = lambda n: any(f == n[0] and a <= n[1] and n[2] <= z and (own or a < n[1]) for f, a, z, own in spans)
        assert sorted(map(tuple, kept.filter("file_id IS NOT NULL").collect())) == sorted(n for n in rows if not inside(n))
        assert kept.filter("file_id IS NULL").count() == 1
        assert "Join" not in _plan(kept)
        frames = nodes.filter("file_id < 3").select("file_id", F.col("pre"), (F.col("pre") + 9).alias("post"), "name")
        found = X.scope_paths(nodes.filter("file_id IS NOT NULL"), frames, block=block)
        assert _plan(found).count("SortMergeJoin") == 1
        want = {n: [x[3] for x in rows if x[0] == n[0] < 3 and x[1] < n[1] and n[2] < x[1] + 9] for n in rows}
        assert {(r["file_id"], r["pre"], r["post"], r["name"]): r["scope_path"] for r in found.collect()} == want


def test_offsets_meet_few_lines(spark):
    """One-character lines: an offset is compared with those of a short stretch only."""
    from scopeforge.operators.ranges import asof_lines
    lines = spark.range(4096).select(F.lit(1).cast("long").alias("file_id"), F.col("id").alias("line"),
                                     (F.col("id") * 2).alias("line_start"), F.lit(1).cast("long").alias("line_len"))
    offsets = spark.range(8192).select(F.lit(1).cast("long").alias("file_id"), F.col("id").alias("off"))
    found = asof_lines(offsets, lines, "file_id")
    assert found.filter("line <> off div 2 OR col <> off % 2").isEmpty() and found.count() == 8192
    block = int(__import__("inspect").signature(asof_lines).parameters["block"].default)
    assert block <= 256


def test_a_pass_leaves_no_stage_tables(spark, tmp_path):
    """What a micro-batch writes on its way is gone when its version is published."""
    import os
    from scopeforge.plans import program_queries as PQ
    from scopeforge.session import shared_dir
    from scopeforge.streaming import passes as P
    held = lambda: set(os.listdir(f"{shared_dir(spark).removeprefix('file://')}/stages"))
    materialize(spark.range(1), "test-held")
    before = held()
    orders = PQ._orders(spark, SF).filter("o_orderkey % 20 = 0")
    version = P.change_files(spark, str(tmp_path / "index"), PQ._events(orders, 1, "change"), PQ._extract(spark, SF))
    assert held() == before
    assert version.table("symbols").select("file_id").distinct().count() == orders.count()
