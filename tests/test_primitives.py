"""Primitive operators checked against brute force on small inputs."""

from pyspark.sql import functions as F

from scopeforge.functions.text import blank_starts, prefix_match, token_starts
from scopeforge.operators.ranges import interval_contains, range_join, sequence_in_group
from scopeforge.operators.skew import salted_join


def test_token_starts(spark):
    rows = [("a bb  ccc",), ("",), ("é x",), (" lead",)]
    out = spark.createDataFrame(rows, "s string").select(token_starts("s", " ").alias("st")).collect()
    assert [r.st for r in out] == [[0, 2, 5, 6], [0], [0, 2], [0, 1]]


def test_blank_starts_equal_token_starts(spark):
    rows = [("a bb  ccc",), ("",), ("é x",), (" lead",), (None,), ("trail ",), ("\U0001f600 y\tz w",), ("x " * 5000,)]
    both = spark.createDataFrame(rows, "s string").coalesce(1).select("s", token_starts("s", " ").alias("a"), blank_starts("s").alias("b"))
    assert all(r.a == r.b for r in both.filter("s IS NOT NULL").collect())


def test_range_join_matches_brute_force(spark):
    pts = [(k, p) for k in range(3) for p in range(0, 700, 13)]
    rgs = [(k, i, lo, lo + w) for k in range(3) for i, (lo, w) in enumerate([(0, 5), (250, 300), (512, 0), (600, 90)])]
    P = spark.createDataFrame(pts, "k int, p int")
    R = spark.createDataFrame(rgs, "k int, rid int, lo int, hi int")
    got = sorted(tuple(r) for r in range_join(P, R, ["k"], "p", "lo", "hi", block=64).select("k", "p", "rid").collect())
    want = sorted((k, p, rid) for k, p in pts for k2, rid, lo, hi in rgs if k == k2 and lo <= p <= hi)
    assert got == want


def test_interval_contains_strict(spark):
    nodes = spark.createDataFrame([(1, 5, 6), (1, 10, 11), (1, 300, 301)], "f int, a int, b int")
    iv = spark.createDataFrame([(1, 0, 1000, "C"), (1, 5, 20, "D")], "f int, lo int, hi int, name string")
    got = sorted(tuple(r) for r in interval_contains(nodes, iv, "f", "a", "b", "lo", "hi", True, 64)
                 .select("a", "name").collect())
    assert got == [(5, "C"), (10, "C"), (10, "D"), (300, "C")]


def test_sequence_in_group(spark):
    df = spark.createDataFrame([(g, v) for g in range(2) for v in range(0, 300, 7)], "g int, v int")
    out = sequence_in_group(df, ["g"], "v", [F.col("v")], block=32).collect()
    for g in range(2):
        seq = sorted((r.v, r.seq) for r in out if r.g == g)
        assert [s for _, s in seq] == list(range(len(seq)))


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i % 10}", i) for i in range(3000)], "key string, v int")
    small = spark.createDataFrame([("hot", "H"), ("k0", "Z"), ("k3", "T")], "key string, tag string")
    got = sorted(tuple(r) for r in salted_join(big, small, ["key"], min_rows=10).collect())
    want = sorted(tuple(r) for r in big.join(small, "key").collect())
    assert got == want


def test_prefix_match(spark):
    df = spark.createDataFrame([("total",), ("Cart",), ("tote",)], "n string")
    assert sorted(r.n for r in df.filter(prefix_match("n", "to")).collect()) == ["total", "tote"]
    assert [r.n for r in df.filter(prefix_match("n", "C[a]")).collect()] == ["Cart"]
    assert df.filter(prefix_match("n", "(")).count() == 0


def test_prefix_patterns_are_the_java_engines(spark):
    """FN-12: classes and groups that only the evaluating engine knows; a bad pattern matches nothing."""
    from scopeforge.functions.text import prefix_match
    df = spark.createDataFrame([("Ärger",), ("ärger",), ("abab",), ("xyz",)], "name string")
    found = lambda p: sorted(r.name for r in df.filter(prefix_match("name", p)).collect())
    assert found(r"\p{Lu}[a-z]") == ["Ärger"]
    assert found(r"(?<two>ab)\k<two>") == ["abab"]
    assert found("ab") == ["abab"] and found("") == sorted(["Ärger", "ärger", "abab", "xyz"])
    assert found("(") == [] and found("a)|(b") == []


def test_groups_of_one_block_are_numbered_without_counts(spark):
    """Blocks are counted only where a group goes beyond block 0; rows without a key or block keep a number."""
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    rows = [(g, v) for g in (0, 1, None) for v in range(0, 30, 7)]
    one = sequence_in_group(spark.createDataFrame(rows, "g int, v int"), ["g"], "v", [F.col("v")], block=32)
    rows += [(0, v) for v in (-40, 31, 32, 64, 65, None)] + [(1, None)]
    more = sequence_in_group(spark.createDataFrame(rows, "g int, v int"), ["g"], "v", [F.col("v")], block=32)
    far = sequence_in_group(spark.createDataFrame(rows, "g int, v int"), ["g"], "v", [F.col("v")], block=32,
                            reach=spark.createDataFrame([(0, 70), (1, None)], "g int, v int"))
    assert "Join" not in plan(one)
    for out in (one, more, far):
        found = out.collect()
        for g in (0, 1, None):
            own = [r.v for r in sorted((r for r in found if r.g == g), key=lambda r: r.seq)]
            assert sorted(r.seq for r in found if r.g == g) == list(range(len(own)))
            assert own == sorted(own, key=lambda v: (v is not None, v or 0))
