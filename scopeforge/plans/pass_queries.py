"""Registered queries of root scans and index passes over a tree of real files, with SQL
oracles that state the tree and the index rebuilt from its last texts."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from ..operators import search as S
from ..session import qualified, shared_dir, write_once
from ..sinks.versions import Store
from ..sources import fixtures as fx
from ..sources import roots as R
from ..streaming import passes as P
from . import search_queries as SQ
from . import sqlparts as sp
from .index import CODE_VERSION, input_key

GLOB = "*.txt"


def _tree(spark, sf_dir) -> str:
    """The tree of the first pass, written once."""
    key = input_key(spark, f"{sf_dir.rstrip('/')}/pages.parquet")
    path = f"{shared_dir(spark)}/trees/pages-{CODE_VERSION}-{key}"
    write_once(spark, path, lambda p: fx.write_page_tree(spark, sf_dir, p))
    return path


def _run(spark, tree: str, **switches) -> P.Run:
    include = spark.createDataFrame([("shared", None)], "path string, interface_only boolean")
    return P.Run(f"{tree}/app", lambda files: fx.page_symbols(spark, files), fx.page_messages, include, f"{tree}/home",
                 glob=GLOB, key=fx.page_key(), in_place=True, **switches)


def q_root_scan(spark, sf_dir):
    """SRC-4, SRC-5, SRC-7: one listing of the workspace, an included folder inside it and
    the lockfile's folders, each file with the flags and the relative path of its own root."""
    tree = _tree(spark, sf_dir)
    run = _run(spark, tree)
    found = R.list_files(spark, R.all_roots(spark, run.workspace, run.include_dirs, run.home), run.workspace, GLOB, key=run.key)
    top = qualified(spark, tree)
    return found.select(
        F.col("file_id").alias("page_id"), "source", F.regexp_replace("root", "^.*/(app|home)/?", "$1/").alias("root"),
        "interface_only", "user_space", F.regexp_replace("rel_path", "/part-.*", "").alias("folder"),
        F.regexp_replace(F.replace("path", F.lit(top), F.lit("")), "/part-.*", "").alias("at"), F.col("length").alias("n_bytes"))


def _passes(spark, sf_dir) -> Store:
    """The index after three passes over a tree of its own: the first, one after changes, one
    after none.  Kept for the data and the code."""
    key = input_key(spark, f"{sf_dir.rstrip('/')}/pages.parquet")
    path = f"{shared_dir(spark)}/passes/pages-{CODE_VERSION}-{key}"

    def build(home: str) -> None:
        fx.write_page_tree(spark, sf_dir, f"{home}/tree")
        run = _run(spark, f"{home}/tree")
        # the mark is a second before a pass begins; what is written from now on is later than it
        time.sleep(2)
        P.index_pass(spark, f"{home}/index", run)
        fx.change_page_tree(spark, sf_dir, f"{home}/tree")
        time.sleep(2)
        P.index_pass(spark, f"{home}/index", run)
        P.index_pass(spark, f"{home}/index", run)

    write_once(spark, path, build)
    return Store(spark, f"{path}/index")


def q_pass_index(spark, sf_dir):
    """SNK-1 .. SNK-4, SNK-6, ST-2, ST-3: the symbols after the passes."""
    return _passes(spark, sf_dir).open().table("symbols").select(
        "file_id", "seq", "user_space", "category", "node_type", "name", "line", "start_col", "end_col")


def q_pass_files(spark, sf_dir):
    """The files that the index holds, with the flags of their roots."""
    return _passes(spark, sf_dir).open().table("files").select(
        F.col("file_id").alias("page_id"), "source", "interface_only", "user_space")


def q_pass_roots(spark, sf_dir):
    """ST-6: each root's outcome in every version."""
    store = _passes(spark, sf_dir)
    name = F.element_at(F.split("root", "/"), -1).alias("root")
    each = [store.open(n).table("roots").select(F.lit(n).alias("version"), name, "source", "status") for n in store.versions()]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out


def q_pass_versions(spark, sf_dir):
    """SNK-4 / SNK-5: published versions; the third pass finds no change and publishes none."""
    store = _passes(spark, sf_dir)
    rows = [(n, v.info["n_changed"], v.info["n_deleted"], v.info["n_docs"]) for n in store.versions() for v in [store.open(n)]]
    return spark.createDataFrame(rows, "version int, n_changed long, n_deleted long, n_symbols long")


def q_pass_term_stats(spark, sf_dir):
    """AGG-1: statistics kept up by signed counts."""
    return _passes(spark, sf_dir).open().table("terms").select("field", "term", "df")


def q_pass_definitions(spark, sf_dir):
    """Q-3 on a version whose scope groups and statistics were kept up, for every usage in
    the query files."""
    index, stats, groups, buckets = P.search_tables(_passes(spark, sf_dir).open())
    probes = SQ._probe_files(index.filter("category = 'usage'")).select("probe_id", "file_id", "line", F.col("start_col").alias("col"))
    hits = S.find_definitions(spark, probes, index, stats, groups=groups, buckets=buckets)
    return hits.select("probe_id", "rank", "file_id", "name", "node_type", "line", "start_col", F.round("score", 6).alias("score"))


def q_pass_diagnostics(spark, sf_dir):
    """SNK-7: the diagnostics after the passes, replaced by file."""
    return _passes(spark, sf_dir).open().table("diagnostics").select("file_id", "message", "start_line", "end_col")


def q_run_switches(spark, sf_dir):
    """CFG-2 / CFG-3 in both positions: files by source and diagnostics of one pass each."""
    tree, out = _tree(spark, sf_dir), None
    for on in (True, False):
        home = f"{shared_dir(spark)}/passes/{uuid.uuid4().hex[:12]}"
        version = P.index_pass(spark, home, _run(spark, tree, include_dependencies=on, report_diagnostics=on))
        n = version.table("files").groupBy("source").agg(F.count("*").alias("n"))
        if "diagnostics" in version.tables:
            n = n.unionByName(version.table("diagnostics").agg(F.count("*").alias("n")).select(F.lit("diagnostics").alias("source"), "n"))
        n = n.select(F.lit(on).alias("switched_on"), "source", "n")
        out = n if out is None else out.unionByName(n)
    return out


QUERIES = {
    "root_scan": q_root_scan,
    "pass_index": q_pass_index,
    "pass_files": q_pass_files,
    "pass_roots": q_pass_roots,
    "pass_versions": q_pass_versions,
    "pass_term_stats": q_pass_term_stats,
    "pass_definitions": q_pass_definitions,
    "pass_diagnostics": q_pass_diagnostics,
    "run_switches": q_run_switches,
}


# ---------------------------------------------------------------- oracles
_FIRST_TREE = """
tree1 AS (
  SELECT page_id, coalesce(html, '') AS html,
         CASE WHEN page_id % 8 < 3 THEN 'app/src' WHEN page_id % 8 = 3 THEN 'app/old' WHEN page_id % 8 = 4 THEN 'app/shared'
              WHEN page_id % 32 = 6 THEN 'home/gems/rough-1.0' ELSE 'home/gems/dep-1.0' END AS spot,
         CASE WHEN page_id % 8 < 4 THEN 'workspace' WHEN page_id % 8 = 4 THEN 'included' ELSE 'dependencies' END AS source
  FROM pages WHERE page_id % 8 NOT IN (5, 7))"""

SQL_ROOT_SCAN = "WITH " + _FIRST_TREE + """
SELECT page_id, source,
       CASE source WHEN 'workspace' THEN 'app/' WHEN 'included' THEN 'app/shared' ELSE spot END AS root,
       source <> 'workspace' AS interface_only, source = 'workspace' AS user_space,
       CASE WHEN source = 'workspace' THEN spot[4:] ELSE '' END || '/page=' || page_id AS folder,
       '/' || spot || '/page=' || page_id AS at,
       (strlen(html) + 1 + CASE WHEN spot LIKE '%rough%' THEN 1 ELSE 0 END)::BIGINT AS n_bytes
FROM tree1"""

#: The files after the changes, with the text that the index holds (the last that parses).
_LAST_TREE = _FIRST_TREE + f""",
tree2 AS (
  SELECT page_id, source, html, CASE WHEN page_id % 32 = 0 THEN 'changed ' || html ELSE html END AS text,
         CASE WHEN page_id % 32 = 0 THEN 'changed ' || html WHEN page_id % 16 = 0 THEN html || ' ###' ELSE html END AS last_text
  FROM tree1 WHERE spot <> 'app/old'
  UNION ALL SELECT page_id + {fx.NEW_PAGE}, 'workspace', html, html, html FROM tree1 WHERE page_id % 8 = 1),
documents AS (SELECT page_id AS doc_id, 'tree' AS lang, 'page' AS source, text FROM tree2 WHERE NOT contains(text, '###'))"""

_SYMBOLS = _LAST_TREE.lstrip() + "," + sp.symbols_cte().replace("\nsymbols AS (", "\nall_symbols AS (") + f""",
symbols AS (
  SELECT s.* REPLACE (t.source = 'workspace' AS user_space) FROM all_symbols s JOIN tree2 t ON t.page_id = s.file_id
  WHERE t.source = 'workspace' OR seq % {fx.SEQ_LINE_SHIFT} % 24 NOT BETWEEN 11 AND 16)"""

SQL_PASS_INDEX = "WITH " + _SYMBOLS + """
SELECT file_id, seq, user_space, category, node_type, name, line, start_col, end_col FROM symbols"""

SQL_PASS_FILES = "WITH " + _LAST_TREE + """
SELECT page_id, source, source <> 'workspace' AS interface_only, source = 'workspace' AS user_space FROM tree2"""

SQL_PASS_ROOTS = """
SELECT v::INTEGER AS version, root, source, CASE WHEN root = 'rough-1.0' AND v = 1 THEN
         CASE WHEN EXISTS (SELECT 1 FROM pages WHERE page_id % 32 = 6) THEN 'pending' ELSE 'done' END ELSE status END AS status
FROM (VALUES (1), (2)) AS versions(v),
     (VALUES ('app', 'workspace', 'open'), ('shared', 'included', 'done'), ('dep-1.0', 'dependencies', 'done'),
             ('rough-1.0', 'dependencies', 'done'), ('gone-1.0', 'dependencies', 'pending')) AS roots(root, source, status)"""

SQL_PASS_VERSIONS = "WITH " + _LAST_TREE + """,
both_documents AS (
  SELECT doc_id + v * 10000000 AS doc_id, lang, source, text FROM (
    SELECT 1 AS v, page_id AS doc_id, 'tree' AS lang, 'page' AS source, html AS text FROM tree1
    WHERE spot NOT LIKE '%rough%' AND NOT contains(html, '###')
    UNION ALL SELECT 2, * FROM documents)),""" + sp.symbols_cte().replace("documents)", "both_documents)").replace(
    "\nsymbols AS (", "\nall_symbols AS (") + f""",
counts AS (
  SELECT file_id // 10000000 AS v, count(*) AS n FROM all_symbols s
  LEFT JOIN tree2 t ON t.page_id = s.file_id % 10000000 LEFT JOIN tree1 o ON o.page_id = s.file_id % 10000000
  WHERE coalesce(t.source, o.source) = 'workspace' OR seq % {fx.SEQ_LINE_SHIFT} % 24 NOT BETWEEN 11 AND 16 GROUP BY 1)
SELECT 1::INTEGER AS version, (SELECT count(*) FROM tree1) AS n_changed, 0::BIGINT AS n_deleted,
       coalesce((SELECT n FROM counts WHERE v = 1), 0) AS n_symbols
UNION ALL SELECT 2, (SELECT count(*) FROM tree2 WHERE page_id % 16 = 0 AND page_id < {fx.NEW_PAGE})
         + (SELECT count(*) FROM tree2 WHERE page_id >= {fx.NEW_PAGE}) + (SELECT count(*) FROM tree1 WHERE spot LIKE '%rough%'),
       (SELECT count(*) FROM tree1 WHERE spot = 'app/old'), coalesce((SELECT n FROM counts WHERE v = 2), 0)"""

SQL_PASS_TERM_STATS = "WITH " + _SYMBOLS + """
SELECT 'scope' AS field, term, CAST(count(*) AS BIGINT) AS df
FROM (SELECT unnest(list_distinct(scope_path)) AS term FROM symbols) GROUP BY term
UNION ALL SELECT 'node_type', node_type, CAST(count(*) AS BIGINT) FROM symbols GROUP BY node_type"""

SQL_PASS_DIAGNOSTICS = "WITH " + _LAST_TREE + """
SELECT page_id AS file_id, 'found ' || mark AS message, 0::BIGINT AS start_line, 0::BIGINT AS end_col
FROM tree2, (VALUES ('###'), ('<br>')) AS marks(mark) WHERE contains(last_text, mark)"""

SQL_RUN_SWITCHES = "WITH " + _FIRST_TREE + """
SELECT v AS switched_on, source, count(*) AS n FROM tree1, (VALUES (TRUE), (FALSE)) AS switch(v)
WHERE (v OR source <> 'dependencies') AND spot NOT LIKE '%rough%' GROUP BY ALL
UNION ALL SELECT TRUE, 'diagnostics', count(*) FROM tree1, (VALUES ('###'), ('<br>')) AS marks(mark)
WHERE spot NOT LIKE '%rough%' AND contains(html, mark)"""


def _definitions_sql() -> str:
    # the branch "every usage" of the definition oracle over these symbols
    whole = SQ.sql_definitions_of("category = 'usage'", _SYMBOLS)
    return whole + "\nSELECT probe_id, rank, file_id, name, node_type, line, start_col, round(score, 6) AS score FROM ranked"


ORACLES = {
    "root_scan": SQL_ROOT_SCAN,
    "pass_index": SQL_PASS_INDEX,
    "pass_files": SQL_PASS_FILES,
    "pass_roots": SQL_PASS_ROOTS,
    "pass_versions": SQL_PASS_VERSIONS,
    "pass_term_stats": SQL_PASS_TERM_STATS,
    "pass_definitions": _definitions_sql(),
    "pass_diagnostics": SQL_PASS_DIAGNOSTICS,
    "run_switches": SQL_RUN_SWITCHES,
}
