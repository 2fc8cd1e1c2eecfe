"""Physical plan shapes the design relies on (checked with explain, not timings)."""

from scopeforge.operators import search as S
from scopeforge.plans import search_queries as SQ
from scopeforge.plans.index import index_stats, symbol_index

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def _formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_workspace_search_pushes_filters_to_parquet(spark):
    p = _formatted(SQ.QUERIES["symbol_search"](spark, SF))
    assert "StringStartsWith(name,th)" in p
    assert "EqualTo(user_space,true)" in p
    assert "TakeOrderedAndProject" in p


def test_point_lookup_broadcasts_checked_probes(spark):
    idx = symbol_index(spark, SF)
    u = S.point_lookup(SQ.line_probes(spark, SF), idx, usage_only=False)
    p = _formatted(u)
    assert "BroadcastHashJoin" in p
    assert "PushedFilters" in p


def test_definitions_top_k_is_a_window_group_limit(spark):
    # rows arrive already partitioned by probe (group scoring windows), so only
    # the final limit is needed
    p = _formatted(SQ.QUERIES["definitions_const"](spark, SF))
    assert "WindowGroupLimit" in p


def test_references_top_k_is_limited_before_the_shuffle(spark):
    p = _formatted(SQ.QUERIES["references"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_stats_are_stored_next_to_the_index(spark):
    st = index_stats(spark, SF)
    assert st.n_docs == symbol_index(spark, SF).count()
    assert "parquet" in _formatted(st.terms).lower()


def test_lookups_of_few_files_read_few_buckets(spark, tmp_path):
    """Static bucket and file filters, and fewer rows out of the scan."""
    from pyspark.sql import functions as F
    from scopeforge.sinks.index import write_symbols
    index = symbol_index(spark, SF)
    write_symbols(index, str(tmp_path / "index"), buckets=16)
    bucketed = spark.read.parquet(str(tmp_path / "index"))
    probes = SQ.symbol_probes(index.filter("file_id = 50"))
    pruned = S.point_lookup(probes, bucketed, usage_only=False, buckets=16)
    p = _formatted(pruned)
    assert "PartitionFilters: [isnotnull(bucket" in p or "PartitionFilters: [(bucket" in p
    assert "GreaterThanOrEqual(file_id,50)" in p and "LessThanOrEqual(file_id,50)" in p
    cut = S.of_files(bucketed, spark.createDataFrame([(50,)], "file_id long"), 16)
    assert len(cut.inputFiles()) == len(bucketed.inputFiles())     # the same table
    read = cut.agg(F.countDistinct("bucket")).first()[0]
    assert read == 1 and cut.count() < bucketed.count()
    whole = S.point_lookup(probes, index, usage_only=False)
    assert sorted(map(tuple, pruned.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_searches_for_few_names_push_them_to_the_groups(spark):
    from pyspark.sql import functions as F
    from scopeforge.plans.index import definition_groups
    groups = definition_groups(spark, SF, 50)[0]
    p = _formatted(S.of_names(groups, spark.createDataFrame([("the",), ("of",)], "name string")))
    assert "In(name, [of,the])" in p
    many = spark.range(S.FEW_NAMES + 5).select(F.col("id").cast("string"))
    assert S.of_names(groups, many) is groups


def test_group_scores_are_limited_before_the_shuffle(spark):
    p = _formatted(SQ.QUERIES["definitions_const"](spark, SF))
    assert p.count("WindowGroupLimit") >= 2 and "Partial" in p


def test_group_limit_equals_ranking_every_pair(spark):
    """Small limits, so that scores tie across the cut, against the whole ranking."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from scopeforge.plans.index import bucketed_index
    index, buckets = bucketed_index(spark, SF)
    stats = index_stats(spark, SF)
    probes = SQ.usage_probes(index, F.lit(True))
    for limit in (1, 3, 20):
        got = S.find_definitions(spark, probes, index.drop("bucket"), stats, limit=limit)
        u = S.point_lookup(probes, index, usage_only=True, buckets=buckets)
        side, _ = S._probe_side(spark, u, stats, S.definition_clauses(), ["usage"])
        pairs = S._type_weights(side.join(index.filter("category = 'assignment'").drop("bucket"), F.col("u_name") == F.col("name")))
        pairs = pairs.filter(S._required_ok()).withColumn("score", F.round(S._score(stats), S.SCORE_DIGITS))
        w = Window.partitionBy("probe_id").orderBy(F.col("score").desc(), "file_id", "line", "start_col", "seq")
        want = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
        cols = ["probe_id", F.col("rank").cast("int").alias("rank"), "file_id", "seq", "score"]
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
