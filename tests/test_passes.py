"""Root scans, index passes, versions and kept-up statistics over small trees of files."""

import os
import time

import pytest
from pyspark.sql import functions as F

from scopeforge.operators import search as S
from scopeforge.operators.stats import term_stats
from scopeforge.session import qualified
from scopeforge.sinks.versions import Store, buckets_for
from scopeforge.sources import roots as R
from scopeforge.streaming import passes as P

OLD = time.time() - 1000


def put(path, text, mtime=OLD):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    os.utime(path, (mtime, mtime))


def extract(files):
    """Every blank-separated word is an assignment on its line, in the scope of its folder."""
    line = files.select("file_id", "file_path", "user_space", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    word = line.select("file_id", "file_path", "user_space", "line", F.posexplode(F.split("s", " ")).alias("i", "name")).filter("name <> ''")
    return word.select(
        "file_id", (F.col("line") * 1000 + F.col("i")).cast("bigint").alias("seq"), F.split("file_path", "/").alias("path_parts"),
        F.lit("assignment").alias("category"), F.array(F.element_at(F.split("file_path", "/"), -2)).alias("scope_path"),
        F.array().cast("array<string>").alias("class_scope"), "name",
        F.when(F.col("name").startswith("C"), "Class").otherwise("Def").alias("node_type"), F.col("line").cast("bigint").alias("line"),
        F.col("i").cast("bigint").alias("start_col"), (F.col("i") + 1).cast("bigint").alias("end_col"), "user_space")


def messages(files):
    zero = F.lit(0).cast("bigint")
    return files.filter(F.col("text").contains("!")).select(
        "file_id", zero.alias("start_line"), zero.alias("start_col"), zero.alias("end_line"), zero.alias("end_col"),
        F.lit("bad").alias("message"), F.lit(False).alias("parse_ok"))


@pytest.fixture
def tree(tmp_path):
    ws = f"{tmp_path}/ws"
    put(f"{ws}/a.rb", "x y\nC1")
    put(f"{ws}/lib/b.rb", "x z")
    put(f"{ws}/lib/inner/c.rb", "inner x")
    put(f"{ws}/lib/inner/vendor/d.rb", "pruned by the inner root")
    put(f"{ws}/vendor/e.rb", "v")
    put(f"{ws}/.github/f.rb", "pruned")
    put(f"{ws}/notes.txt", "no source")
    put(f"{ws}/Gemfile.lock", "GEM\n    dep (1.0)\n    rough (2.0)\n      sub (3.0)\n")
    put(f"{tmp_path}/home/gems/dep-1.0/g.rb", "g x")
    put(f"{tmp_path}/home/gems/rough-2.0/h.rb", b"\xff\xfe")
    put(f"{tmp_path}/home/gems/rough-2.0/i.rb", "i")
    put(f"{tmp_path}/home/gems/sub-3.0/j.rb", "not in the lockfile")
    return str(tmp_path)


def a_run(spark, tree, **more):
    include = spark.createDataFrame([("lib/inner", False)], "path string, interface_only boolean")
    return P.Run(f"{tree}/ws", extract, messages, include, f"{tree}/home", **more)


def names(version):
    return sorted((r.p[-1], r.name) for r in version.table("symbols").select(F.col("path_parts").alias("p"), "name").collect())


def rows(df):
    return sorted(map(str, df.collect()))


def test_files_belong_to_the_longest_root(spark, tree):
    run = a_run(spark, tree)
    roots = R.all_roots(spark, run.workspace, run.include_dirs, run.home, "/no/such/ruby")
    got = {os.path.basename(r.path): r for r in R.list_files(spark, roots, run.workspace).collect()}
    assert sorted(got) == ["a.rb", "b.rb", "c.rb", "e.rb", "g.rb", "h.rb", "i.rb"]
    assert (got["a.rb"].source, got["a.rb"].user_space, got["a.rb"].interface_only, got["a.rb"].rel_path) == ("workspace", True, False, "/a.rb")
    # nested root: its own flags, path below it, prune list; its key is still that of the workspace path
    c = got["c.rb"]
    assert (c.source, c.user_space, c.interface_only, c.rel_path, c.file_path) == ("included", False, False, "/c.rb", "/lib/inner/c.rb")
    g = got["g.rb"]
    assert (g.source, g.interface_only, g.rel_path) == ("dependencies", True, "/g.rb")
    assert g.file_path == f"{tree}/home/gems/dep-1.0/g.rb" and len(g.file_id) == 64
    here, outer = R.present_roots(spark, roots)
    assert outer == sorted(qualified(spark, p) for p in (f"{tree}/ws", f"{tree}/home/gems/dep-1.0", f"{tree}/home/gems/rough-2.0"))


def test_no_lockfile_no_dependencies(spark, tree):
    os.remove(f"{tree}/ws/Gemfile.lock")
    roots = R.all_roots(spark, f"{tree}/ws", None, f"{tree}/home", "/usr/lib/ruby")
    assert [r.source for r in roots.collect()] == ["workspace"]


def test_passes_replace_delete_and_skip(spark, tree):
    run, home = a_run(spark, tree), f"{tree}/index"
    one = P.index_pass(spark, home, run)
    assert names(one) == sorted([("a.rb", "x"), ("a.rb", "y"), ("a.rb", "C1"), ("b.rb", "x"), ("b.rb", "z"), ("c.rb", "inner"),
                                 ("c.rb", "x"), ("e.rb", "v"), ("g.rb", "g"), ("g.rb", "x"), ("i.rb", "i")])
    status = {r.root.rsplit("/", 1)[-1]: r.status for r in one.table("roots").collect()}
    assert status == {"ws": "open", "inner": "done", "dep-1.0": "done", "rough-2.0": "pending"}
    assert P.index_pass(spark, home, run) is None and Store(spark, home).versions() == [1]  # nothing changed
    reader = one.table("symbols")
    before = rows(reader)
    put(f"{tree}/ws/a.rb", "x fresh", time.time() + 5)          # changed
    put(f"{tree}/ws/lib/k.rb", "moved in", OLD)                 # new, with an old time
    put(f"{tree}/ws/vendor/e.rb", "v !", time.time() + 5)       # no longer parses: old symbols stay
    os.remove(f"{tree}/ws/lib/b.rb")                            # gone
    os.remove(f"{tree}/home/gems/dep-1.0/g.rb")                 # a run-once root that is done is not looked at
    put(f"{tree}/home/gems/rough-2.0/h.rb", "mended")           # the pending one is scanned again
    two = P.index_pass(spark, home, run)
    assert two.number == 2 and two.info["n_deleted"] == 1
    assert names(two) == sorted([("a.rb", "x"), ("a.rb", "fresh"), ("k.rb", "moved"), ("k.rb", "in"), ("c.rb", "inner"), ("c.rb", "x"),
                                 ("e.rb", "v"), ("g.rb", "g"), ("g.rb", "x"), ("h.rb", "mended"), ("i.rb", "i")])
    assert {r.status for r in two.table("roots").filter("source = 'dependencies'").collect()} == {"done"}
    assert [r.message for r in two.table("diagnostics").collect()] == ["bad"]
    # a reader of the first version keeps its answer; an older version can be opened again
    assert rows(reader) == before and rows(Store(spark, home).open(1).table("symbols")) == before
    Store(spark, home).vacuum(keep=1)
    assert Store(spark, home).versions() == [2] and len(names(Store(spark, home).open())) == 11


def test_failed_pass_leaves_the_version(spark, tree):
    run, home = a_run(spark, tree), f"{tree}/index"
    one = P.index_pass(spark, home, run)
    put(f"{tree}/ws/a.rb", "later", time.time() + 5)

    def broken(files):
        return extract(files).withColumn("name", F.raise_error(F.lit("no")).cast("string"))

    with pytest.raises(Exception):
        P.index_pass(spark, home, P.Run(run.workspace, broken, None, run.include_dirs, run.home))
    assert Store(spark, home).versions() == [1] and names(Store(spark, home).open()) == names(one)
    two = P.index_pass(spark, home, run)     # the change is found again
    assert ("a.rb", "later") in names(two)
    draft = Store(spark, home).begin()
    Store(spark, home).begin().publish({})
    with pytest.raises(RuntimeError):        # two writers of one number
        draft.publish({})


def test_strict_pass_stops_at_unreadable_workspace_file(spark, tree):
    put(f"{tree}/ws/bad.rb", b"\xff")
    with pytest.raises(ValueError):
        P.index_pass(spark, f"{tree}/index", a_run(spark, tree, strict=True))
    assert Store(spark, f"{tree}/index").versions() == []
    assert P.index_pass(spark, f"{tree}/index", a_run(spark, tree)).number == 1


@pytest.mark.parametrize("limit", [2, 50])
def test_kept_up_groups_and_statistics_equal_a_rebuild(spark, tmp_path, limit):
    """Files with a common name come, change and go; a small limit makes groups be filled
    again from the index."""
    ws, home = f"{tmp_path}/ws", f"{tmp_path}/index"
    for i in range(12):
        put(f"{ws}/d{i % 2}/f{i:02}.rb", f"common n{i} common C{i % 3}")
    run = P.Run(ws, extract, limit=limit)
    P.index_pass(spark, home, run)
    for step in range(3):
        now = time.time() + 10 * (step + 1)
        os.remove(f"{ws}/d0/f{2 * step:02}.rb")
        put(f"{ws}/d1/f{2 * step + 1:02}.rb", f"common only{step}", now)
        put(f"{ws}/d1/a{step}.rb", "common C1 common", now)
        version = P.index_pass(spark, home, run, now=now - 5)
        index, stats, (groups, members, k), _ = P.search_tables(version)
        index = index.drop("bucket")
        want_groups, want_members = S.scope_groups(index, "assignment", limit)
        order = sorted(want_groups.columns)
        assert rows(groups.select(order)) == rows(want_groups.select(order))
        order = sorted(want_members.columns)
        assert rows(members.select(order)) == rows(want_members.select(order))
        order = ["field", "term", "df"]
        assert rows(version.table("terms").select(order)) == rows(term_stats(index).select(order))
        n, mean = index.agg(F.count("*"), F.avg(F.size("scope_path"))).first()
        assert stats.n_docs == n and abs(stats.avg_len - mean) < 1e-12


def test_buckets_follow_the_bytes():
    assert buckets_for(0, 8) == 8 and buckets_for(100 << 20, 8) == 13 and buckets_for(1 << 60, 8) == 1 << 16


def test_late_and_repeated_events_lose(spark, tmp_path):
    """Versions decide, not arrival; a text with a message keeps the old symbols but shows the message."""
    home = f"{tmp_path}/index"
    schema = "file_id long, version long, event_type string, text string, length long"

    def batch(*events):
        P.change_files(spark, home, spark.createDataFrame([(*e, 10) for e in events], schema), words, bad)
        version = Store(spark, home).open()
        return (sorted((r.file_id, r.name) for r in version.table("symbols").collect()),
                sorted((r.file_id, r.message) for r in version.table("diagnostics").collect()))

    def words(events):
        return extract(events.withColumn("file_path", F.concat(F.lit("/d/f"), "file_id")).withColumn("user_space", F.lit(True)))

    def bad(events):
        return events.filter(F.col("text").contains("!")).select("file_id", F.lit("bad").alias("message"))

    assert batch((1, 5, "change", "a b"), (1, 4, "save", "older"), (2, 1, "open", "x"), (3, 1, "change", "c !")) == (
        [(1, "a"), (1, "b")], [(3, "bad")])
    assert batch((1, 3, "change", "late"), (1, 5, "change", "a b"), (3, 2, "change", "c"), (2, 2, "save", "y")) == (
        [(1, "a"), (1, "b"), (2, "y"), (3, "c")], [])
    assert batch((1, 6, "change", "new !"), (2, 3, "delete", None)) == ([(1, "a"), (1, "b"), (3, "c")], [(1, "bad")])
    n = Store(spark, home).versions()
    batch((1, 6, "change", "new !"), (2, 3, "change", "again"), (3, 1, "change", "late"))
    assert Store(spark, home).versions() == n        # nothing later than what is held: no version
    version = Store(spark, home).open()
    index = version.table("symbols").drop("bucket")
    assert rows(version.table("terms").select("field", "term", "df")) == rows(term_stats(index).select("field", "term", "df"))
