"""Trees on a mounted file system: walked, read and written by the tasks, as Spark's source sees them."""

import os

import pytest
from pyspark.sql import functions as F

from scopeforge.session import qualified
from scopeforge.sources import fixtures as fx
from scopeforge.sources import roots as R

SF = "/root/testdata/sf0.001"
NAMES = ["a.rb", "b.txt", ".hidden.rb", "_skipped.rb", "_kept=1.rb", "c._COPYING_", "d [1].rb", "é ü.rb", "deep/x/y/z/e.rb",
         "_no/f.rb", ".git/g.rb", "page=1/h.rb", "empty/", "wide/0/i.rb", "wide/1/j.rbx", "wide/2/k.rb"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def top(tmp_path):
    for name in NAMES:
        os.makedirs(os.path.dirname(f"{tmp_path}/t/{name}"), exist_ok=True)
        if not name.endswith("/"):
            with open(f"{tmp_path}/t/{name}", "wb") as f:
                f.write(name.encode() + b"\xff")
            os.utime(f"{tmp_path}/t/{name}", (1_700_000_000.123456, 1_700_000_000.123456))
    os.symlink(f"{tmp_path}/none", f"{tmp_path}/t/broken.rb")
    os.symlink(f"{tmp_path}/t/wide", f"{tmp_path}/t/linked")
    return f"{tmp_path}/t"


@pytest.mark.parametrize("glob", ["*.rb", "*.{rb,txt}", "[ad]*", "*"])
def test_walk_finds_what_the_file_source_lists(spark, top, glob):
    found = R._listed(spark, [qualified(spark, top)], glob)
    want = R._binary(spark, [top], glob).select("path", F.col("modificationTime").alias("mtime"), "length")
    assert sorted(found.collect()) == sorted(want.collect()) and want.count() >= 2
    assert "binaryFile" not in _plan(found)      # which starts a task for each folder, and holds the listing in the driver


def test_folders_that_a_task_leaves_are_dealt_out_again(spark, top):
    names = lambda df: sorted(r.path for r in df.collect())
    at = [qualified(spark, top)]
    assert names(R._walked(spark, at, most=1)) == names(R._walked(spark, at)) and len(names(R._walked(spark, at))) > 10


def test_chosen_files_are_read_by_a_few_tasks(spark, top, monkeypatch):
    roots = spark.createDataFrame([(top,)], "root string")
    chosen = R._listed(spark, [qualified(spark, top)], "*.rb")
    read = R.read_contents(spark, roots, chosen, "*.rb")
    assert "binaryFile" not in _plan(read) and "Join" not in _plan(read)
    monkeypatch.setattr(R, "mounted", lambda paths: False)      # the way of other stores
    assert sorted(read.collect()) == sorted(R.read_contents(spark, roots, chosen, "*.rb").collect())
    assert all(bytes(r.content).endswith(b"\xff") for r in read.collect())


def test_page_trees_are_alike_by_tasks_and_by_sparks_writer(spark, tmp_path, monkeypatch):
    def files(path):
        return sorted((os.path.dirname(os.path.relpath(f"{d}/{n}", path)), open(f"{d}/{n}", "rb").read())
                      for d, _, names in os.walk(path) for n in names if n.endswith(".txt"))

    for name in ("tasks", "writer"):
        fx.write_page_tree(spark, SF, f"{tmp_path}/{name}")
        monkeypatch.setattr(R, "mounted", lambda paths: False)
    monkeypatch.undo()
    assert files(f"{tmp_path}/tasks") == files(f"{tmp_path}/writer") and len(files(f"{tmp_path}/tasks")) > 30
    # no process for the mode of a file: no checksum files either
    assert not [n for d, _, names in os.walk(f"{tmp_path}/tasks/app/src") for n in names if n.endswith(".crc")]
    for name in ("tasks", "writer"):
        fx.change_page_tree(spark, SF, f"{tmp_path}/{name}")
        monkeypatch.setattr(R, "mounted", lambda paths: False)
    assert files(f"{tmp_path}/tasks") == files(f"{tmp_path}/writer")


def test_pages_of_one_number_are_lines_of_one_file(spark, tmp_path):
    pages = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b"), ("f", 2, ""), (None, 3, "c"), ("f", None, "d")], "folder string, page long, text string")
    for replace in (False, True, True):
        fx._write_pages(spark, pages, f"{tmp_path}/p", replace)
    found = {(d[-6:], open(f"{d}/{n}").read()) for d, _, names in os.walk(f"{tmp_path}/p") for n in names}
    assert found in ({("page=1", "a\nb\n"), ("page=2", "\n")}, {("page=1", "b\na\n"), ("page=2", "\n")})


def test_symbols_of_files_are_made_and_written_where_the_files_are(spark, tmp_path):
    """The flags of a file go with its text: symbols meet no join, and a first version no shuffle of them."""
    from scopeforge.plans.pass_queries import _run
    from scopeforge.streaming import passes as P
    files = spark.createDataFrame([(n, n % 2 == 0, n % 3 == 0, f"a b c d\ne f{n} {'x y ' * 9}") for n in range(1, 9)],
                                  "file_id long, user_space boolean, interface_only boolean, text string")
    made = fx.page_symbols(spark, files)
    assert "MergeJoin" not in _plan(made) and _plan(made).count("Exchange") == 1      # the rules
    docs = files.select(F.col("file_id").alias("doc_id"), F.lit("tree").alias("lang"), F.lit("page").alias("source"), "text")
    slot = F.col("seq") % fx.SEQ_LINE_SHIFT % len(fx.DOC_TOKEN_KINDS)
    want = fx.document_symbols(spark, docs).drop("user_space").join(files.drop("text"), "file_id").filter(
        ~(F.col("interface_only") & slot.between(*fx.INTERFACE_SLOTS))).select(*made.columns)
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    fx.write_page_tree(spark, SF, f"{tmp_path}/tree")
    plain, dealt = (P.index_pass(spark, f"{tmp_path}/{name}", P.Run(**{**vars(_run(spark, f"{tmp_path}/tree")), "in_place": name == "dealt"}))
                    for name in ("plain", "dealt"))
    for name in ("symbols", "files", "terms", "groups", "members"):
        columns = sorted(plain.table(name).columns)
        got = [sorted(map(str, v.table(name).select(columns).collect())) for v in (plain, dealt)]
        assert got[0] == got[1] and got[0]
