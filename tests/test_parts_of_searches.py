"""Searches that go through an index part by part give what one that takes it at once gives."""

from pyspark.sql import functions as F

from scopeforge.operators import search as S
from scopeforge.plans import index as I
from scopeforge.plans import search_queries as SQ

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_definitions_by_parts_of_the_groups(spark, monkeypatch):
    whole = {q: rows(SQ.QUERIES[q](spark, SF)) for q in ("definitions_other", "definitions_const")}
    monkeypatch.setattr(I, "PART_BYTES", 100_000)
    groups, members, limit, parts = I.definition_groups(spark, SF, 50)
    assert parts > 2 and members.select("part").distinct().count() == parts
    for q, want in whole.items():
        assert rows(SQ.QUERIES[q](spark, SF)) == want and len(want) > 500
    # a first version of the groups has the same groups; only their number stops at the limit
    plain, _ = S.scope_groups(I.symbol_index(spark, SF), "assignment", limit)
    same = [*S.GROUP_KEYS, F.least("n", F.lit(limit)).alias("n"), "scope_path", "first"]
    assert rows(groups.select(*same)) == rows(plain.select(*same))


def test_members_and_probes_leave_little_on_disk(spark):
    """One shuffle makes groups and members, of what a hit shows."""
    made = S.group_members(I.symbol_index(spark, SF), "assignment", 50)._jdf.queryExecution().executedPlan().toString()
    assert made.count("Exchange hashpartitioning") == 1 and "class_scope" not in made
    I.definition_groups(spark, SF, 50)
    files = I.symbol_index(spark, SF).inputFiles()
    assert files and all(".zstd." in f for f in files)


def test_many_probes_meet_the_index_by_groups_of_buckets(spark, monkeypatch):
    index, buckets = I.bucketed_index(spark, SF)
    probes = SQ.line_probes(spark, SF)
    want = rows(S.point_lookup(probes, index, usage_only=False, buckets=buckets))
    assert len(want) > 500
    few = S.broadcast_if_small
    monkeypatch.setattr(S, "broadcast_if_small", lambda df, *a: few(df, 200))
    monkeypatch.setattr(S, "LOOKUP_ROWS", 150)
    assert len(S._bucket_groups(probes, buckets)) > 2
    found = S.point_lookup(probes, index, usage_only=False, buckets=buckets)
    assert rows(found) == want and "Join" not in found._jdf.queryExecution().executedPlan().toString()
