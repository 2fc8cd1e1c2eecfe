"""Source rules that are easy to get wrong."""

from pyspark.sql import functions as F

from scopeforge.sources import files as SRC


def test_prune_is_a_substring_test_on_directories_only(spark):
    root = "file:/ws"
    paths = ["file:/ws/app/a.rb", "file:/ws/.github/x.rb", "file:/ws/lib/tmpfiles/b.rb",
             "file:/ws/lib/node_modules_b.rb", "file:/ws/vendor/c.rb"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = sorted(r.path for r in SRC.prune(df, "path", root, SRC.WORKSPACE_PRUNE).collect())
    # '.github' goes with '.git', 'tmpfiles' with 'tmp'; file names are not tested;
    # 'vendor' is pruned only outside the workspace
    assert kept == ["file:/ws/app/a.rb", "file:/ws/lib/node_modules_b.rb", "file:/ws/vendor/c.rb"]
    other = sorted(r.path for r in SRC.prune(df, "path", root, SRC.OTHER_PRUNE).collect())
    assert "file:/ws/vendor/c.rb" not in other


def test_lockfile_needs_exactly_four_blanks(spark):
    lines = ["    rake (13.0.6)", "  rake (13.0.6)", "      rake (13.0.6)", "    json-pure_x.1 (2.7.1)",
             "GEM", "    bad name (1.0)"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = sorted(tuple(r) for r in SRC.lockfile_entries(df).collect())
    assert got == [("json-pure_x.1", "2.7.1"), ("rake", "13.0.6")]


def test_decode_splits_invalid_utf8(spark):
    df = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"\xff\xfe"))],
                               "path string, content binary")
    good, bad = SRC.decode(df, strict=False)
    assert [r.path for r in good.collect()] == ["a"] and [r.path for r in bad.collect()] == ["b"]
    assert good.select(F.col("text")).first().text == "ok"
