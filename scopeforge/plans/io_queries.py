"""Registered queries of sources, diagnostics, index maintenance and change feeds,
with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import absolute_path, file_key, join_path, relative_path, split_path, user_space_flag
from ..operators import diagnostics as D
from ..session import materialize, qualified, shared_dir, write_once
from ..operators.skew import salted_join
from ..sinks.index import publish_versions, replace_files
from ..sources import files as SRC
from ..sources import fixtures as fx
from ..streaming import feed as FD
from ..streaming import live as LV
from . import sqlparts as sp
from .index import input_key

# Fixture parameters (FIXTURES.md §2.5).
WORKSPACE = "/workspace"
WORKSPACE_HOST = "example.org"           # user-space test: the url contains it
PRUNE_WORDS = ["en", "fr"]
GEM_HOME = "/home/dev/.gem/ruby"
STDLIB_ROOT = "/usr/lib/ruby/3.3.0"
ROOT_RE = r"^([^/]*//[^/]*)"
TREE_GLOB = "*.txt"
PAGE_LINES = 8                              # lines of a page of diagnostics
SALT_MIN_ROWS = 100_000                      # the fixture tree is written by Spark's text writer


def _pages(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages")
    root = F.regexp_extract("url", ROOT_RE, 1)
    return p.select("page_id", "url", root.alias("root")).withColumn("rel_path", relative_path("url", F.col("root")))


def q_path_functions(spark, sf_dir):
    p = _pages(spark, sf_dir).withColumn("parts", split_path("rel_path"))
    return p.select("page_id", "root", "rel_path", F.array_join("parts", "|").alias("parts"),
                    F.size("parts").cast("bigint").alias("n_parts"),
                    absolute_path("parts", F.lit(True), F.col("root")).alias("abs_user"),
                    absolute_path("parts", F.lit(False), F.col("root")).alias("abs_other"),
                    join_path("parts").alias("joined"))


def q_user_space_flag(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", user_space_flag("url", WORKSPACE_HOST).alias("user_space"))


def q_file_keys(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "rel_path", file_key("rel_path").alias("file_key"))


def q_prune_paths(spark, sf_dir):
    p = _pages(spark, sf_dir)
    dirs = F.slice(split_path("rel_path"), 1, F.greatest(F.size(split_path("rel_path")) - 1, F.lit(0)))
    hit = F.exists(dirs, lambda d: SRC._any_contains(d, PRUNE_WORDS))
    return p.filter(~hit).select("page_id", "rel_path")


def _lock_lines(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier")
    entry = F.concat(F.regexp_replace("s_name", "#", "-"), F.lit(" ("), F.col("s_suppkey").cast("string"), F.lit(".0)"))
    lines = F.array(F.concat(F.lit("    "), entry), F.concat(F.lit("  "), entry), F.concat(F.lit("      "), entry))
    return s.select(F.explode(lines).alias("value"))


def q_lockfile_deps(spark, sf_dir):
    return SRC.lockfile_entries(_lock_lines(spark, sf_dir))


def q_dependency_roots(spark, sf_dir):
    return SRC.dependency_roots(SRC.lockfile_entries(_lock_lines(spark, sf_dir)), GEM_HOME, STDLIB_ROOT)


def _included_dirs(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    brand = F.lower(F.regexp_replace("p_brand", "#", "_"))
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/opt/vendor/"), brand)) \
        .otherwise(F.concat(F.lit("lib/"), F.lower("p_type"), F.lit("/"), brand))
    io = F.when(F.col("p_size") % 5 == 0, F.lit(None).cast("boolean")).otherwise(F.col("p_size") % 3 != 0)
    return p.select(path.alias("path"), io.alias("interface_only"))


def q_included_roots(spark, sf_dir):
    return SRC.included_roots(_included_dirs(spark, sf_dir), WORKSPACE)


def _union(spark, sf_dir, include_deps=True):
    ws = _pages(spark, sf_dir).select(F.col("root"), F.lit(False).alias("interface_only"),
                                       F.lit(True).alias("user_space")).distinct()
    inc = SRC.included_roots(_included_dirs(spark, sf_dir), WORKSPACE)
    deps = q_dependency_roots(spark, sf_dir) if include_deps else None
    return SRC.source_union(ws, inc, deps)


def q_source_union(spark, sf_dir):
    return _union(spark, sf_dir).select("source", "root", "interface_only", "user_space")


def q_run_config(spark, sf_dir, include_dependencies=False, report_diagnostics=False):
    """CFG-2 / CFG-3: the two switches applied to the union of sources and to the
    diagnostics of the documents."""
    u = _union(spark, sf_dir, include_dependencies).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    dn = spark.range(0)     # switched off: the job is not run at all
    if report_diagnostics:
        dn = _diags(spark, sf_dir)
    dn = dn.agg(F.count(F.lit(1)).alias("n")).select(F.lit("diagnostics").alias("source"), "n")
    return u.unionByName(dn)


# ---------------------------------------------------------------- diagnostics
def _diags(spark, sf_dir):
    """Parser messages of the documents fixture: every non-empty line whose text
    occurs more than once over all documents, spanning its first to last character."""
    docs = fx.table(spark, sf_dir, "documents")
    lines = fx.document_lines(docs).withColumnRenamed("doc_id", "file_id")
    nonempty = lines.filter(F.col("line_len") > 0)
    # line frequencies, pre-aggregated and written once: they give both the
    # duplicated lines and the hot lines to salt, with their number of rows
    freq = materialize(nonempty.groupBy("line_text").agg(F.count(F.lit(1)).alias("n")), "line-freq")
    dup = freq.filter("n > 1").select("line_text")
    hot = freq.filter(F.col("n") > SALT_MIN_ROWS).select("line_text", F.col("n").alias("_n"))
    # a very common line (think `end`) is split over several tasks on the line side
    msgs = salted_join(nonempty, dup, ["line_text"], "left_semi", hot=hot, min_rows=SALT_MIN_ROWS).select(
        "file_id", F.col("line").alias("msg_id"), F.lit("repeated line").alias("message"),
        F.col("line_start").alias("begin_off"), (F.col("line_start") + F.col("line_len") - 1).alias("end_off"))
    return D.to_diagnostics(msgs, lines.select("file_id", "line", "line_start", "line_len"))


def q_diagnostics(spark, sf_dir):
    return _diags(spark, sf_dir)


def q_diagnostics_by_file(spark, sf_dir):
    return D.by_file(_diags(spark, sf_dir))


def q_diagnostics_pages(spark, sf_dir):
    return D.by_file(_diags(spark, sf_dir), page_lines=PAGE_LINES)


def q_diagnostics_gate(spark, sf_dir):
    files = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"),
                                                        F.lit(True).alias("parse_ok"))
    return D.gate(files, _diags(spark, sf_dir))


# ---------------------------------------------------------------- change feed
def _feed(spark, sf_dir):
    return FD.events_feed(fx.table(spark, sf_dir, "events"))


def q_latest_text_per_file(spark, sf_dir):
    return FD.latest_text_agg(_feed(spark, sf_dir))


def q_changed_files(spark, sf_dir):
    return FD.changed_files(_feed(spark, sf_dir))


def q_deleted_files(spark, sf_dir):
    return FD.deleted_files(_feed(spark, sf_dir))


def q_skip_unchanged(spark, sf_dir):
    return FD.pass_grid(_feed(spark, sf_dir))


def q_replace_by_file(spark, sf_dir):
    """SNK-1..3: the pass from the second-to-last day to the last day.  Old index =
    tokens of each file's latest text up to day d; files changed on day d + 1 are
    replaced, files of day d without an event on day d + 1 are deleted."""
    f = FD.with_day(_feed(spark, sf_dir))
    last = f.agg(F.max("day").alias("d")).first()["d"]
    old_feed = f.filter(F.col("day") < F.lit(last))
    new_feed = f.filter(F.col("day") == F.lit(last))
    old = FD.text_tokens(FD.latest_text_agg(old_feed))
    changed = FD.latest_text_agg(new_feed)
    prev_day = old_feed.filter(F.col("day") == F.date_sub(F.lit(last), 1)).select("file_id").distinct()
    deleted = prev_day.join(new_feed.select("file_id").distinct(), "file_id", "left_anti")
    return replace_files(old, FD.text_tokens(changed), changed, deleted)


def q_run_once_roots(spark, sf_dir):
    """ST-6: dependency and included roots are scanned once; a root whose scan
    fails (fixture: supplier with a negative balance) stays pending."""
    s = fx.table(spark, sf_dir, "supplier")
    entry = F.concat(F.regexp_replace("s_name", "#", "-"), F.lit("-"), F.col("s_suppkey").cast("string"), F.lit(".0"))
    roots = s.select(F.concat(F.lit(GEM_HOME + "/gems/"), entry).alias("root"), (F.col("s_acctbal") >= 0).alias("ok"))
    done = roots.filter("ok").select("root")
    pending = roots.select("root").join(done, "root", "left_anti")
    return done.withColumn("status", F.lit("done")).unionByName(pending.withColumn("status", F.lit("pending")))


def q_index_versions(spark, sf_dir):
    """SNK-4 / SNK-5: one committed version per daily pass that changed or deleted
    something (empty passes are skipped and publish nothing), numbered in pass
    order.  The records are written to a versions table in the shared folder and
    read back, as readers resolve the latest version from it."""
    from pyspark.sql import Window
    feed = _feed(spark, sf_dir)
    ch = FD.changed_files(feed).groupBy("pass_day").agg(F.count(F.lit(1)).alias("n_changed"))
    de = FD.deleted_files(feed).groupBy("pass_day").agg(F.count(F.lit(1)).alias("n_deleted"))
    v = (ch.join(de, "pass_day", "full")
         .select("pass_day", F.coalesce("n_changed", F.lit(0)).alias("n_changed"),
                 F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"))
         .filter((F.col("n_changed") > 0) | (F.col("n_deleted") > 0)))
    # one row per pass (a handful per day of data), so a global window is cheap
    v = v.withColumn("version", F.row_number().over(Window.orderBy("pass_day")).cast("bigint"))
    import uuid
    path = f"{shared_dir(spark)}/versions/{uuid.uuid4().hex[:12]}"
    publish_versions(v, path)
    return spark.read.parquet(path).select("version", "pass_day", "n_changed", "n_deleted")


def _doc_tree(spark, sf_dir) -> str:
    key = input_key(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    path = f"{shared_dir(spark)}/trees/docs-{key}"
    write_once(spark, path, lambda p: fx.write_document_tree(fx.table(spark, sf_dir, "documents"), p))
    return qualified(spark, path)


def _scanned(spark, sf_dir):
    """SRC-1 + SRC-2 + SRC-8 over the written tree: list and read in the executors,
    drop pruned directories, split valid and invalid UTF-8 files."""
    root = _doc_tree(spark, sf_dir)
    files = SRC.scan_tree(spark, root, TREE_GLOB)
    kept = SRC.prune(files, "path", root, SRC.WORKSPACE_PRUNE)
    good, bad = SRC.decode(kept, strict=False)
    where = lambda df: df.select("*", F.regexp_extract("path", "/lang=([^/]+)/", 1).alias("lang"),
                                 F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"))
    return where(good), where(bad)


def q_tree_scan(spark, sf_dir):
    good, _ = _scanned(spark, sf_dir)
    return good.groupBy("lang", "source").agg(F.sum("length").cast("bigint").alias("n_bytes"),
                                              F.sum(F.length("text")).cast("bigint").alias("n_chars"))


def q_bad_file_skip(spark, sf_dir):
    _, bad = _scanned(spark, sf_dir)
    return bad.select("lang", "source").distinct()


def _feed_files(spark, sf_dir) -> str:
    key = input_key(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    path = f"{shared_dir(spark)}/feeds/events-{key}"
    write_once(spark, path, lambda p: LV.write_feed_files(_feed(spark, sf_dir), p))
    return path


def q_stream_live_upsert(spark, sf_dir):
    st = LV.live_state(spark, _feed_files(spark, sf_dir))
    return st.select("file_id", "version", "text", "ts")


def q_stream_diagnostics(spark, sf_dir):
    st = LV.live_state(spark, _feed_files(spark, sf_dir), event_types=None)
    return st.filter(F.col("event_type") == "failed").select(
        "file_id", "version", F.lit("parse failed").alias("message"))


def _feed_documents(texts):
    return texts.select(F.col("file_id").alias("doc_id"), F.lit("feed").alias("lang"), F.lit("feed").alias("source"), "text")


def _feed_messages(texts):
    """EXT-13 on the texts that fail to parse: one message over the whole text."""
    docs = _feed_documents(texts.filter("event_type = 'failed'"))
    lines = fx.document_lines(docs).withColumnRenamed("doc_id", "file_id")
    msgs = docs.select(F.col("doc_id").alias("file_id"), F.lit(0).cast("bigint").alias("msg_id"),
                       F.lit("parse failed").alias("message"), F.lit(0).cast("bigint").alias("begin_off"),
                       F.length("text").cast("bigint").alias("end_off"))
    return D.to_diagnostics(msgs, lines.select("file_id", "line", "line_start", "line_len"))


def _live(spark, sf_dir):
    """The index after the feed's micro-batches, and its statistics and groups with it."""
    return LV.live_index(spark, _feed_files(spark, sf_dir),
                         lambda texts: fx.document_symbols(spark, _feed_documents(texts)), _feed_messages)


def q_stream_index(spark, sf_dir):
    """ST-4: the symbol index after all micro-batches; a text that fails leaves the old rows."""
    return _live(spark, sf_dir).open().table("symbols").select(
        "file_id", "seq", "category", "node_type", "name", "line", "start_col", "end_col")


def q_stream_index_diagnostics(spark, sf_dir):
    """ST-5 / SNK-7: the diagnostics table after all micro-batches."""
    return _live(spark, sf_dir).open().table("diagnostics").drop("bucket")


def q_stream_term_stats(spark, sf_dir):
    """AGG-1 on the live path: the statistics follow every micro-batch."""
    return _live(spark, sf_dir).open().table("terms").select("field", "term", "df")


def q_stream_periodic_refresh(spark, sf_dir):
    return LV.refresh_passes(spark, _feed_files(spark, sf_dir))


QUERIES = {
    "path_functions": q_path_functions,
    "user_space_flag": q_user_space_flag,
    "file_keys": q_file_keys,
    "prune_paths": q_prune_paths,
    "lockfile_deps": q_lockfile_deps,
    "dependency_roots": q_dependency_roots,
    "included_roots": q_included_roots,
    "source_union": q_source_union,
    "run_config": q_run_config,
    "diagnostics": q_diagnostics,
    "diagnostics_by_file": q_diagnostics_by_file,
    "diagnostics_pages": q_diagnostics_pages,
    "diagnostics_gate": q_diagnostics_gate,
    "latest_text_per_file": q_latest_text_per_file,
    "changed_files": q_changed_files,
    "deleted_files": q_deleted_files,
    "skip_unchanged": q_skip_unchanged,
    "replace_by_file": q_replace_by_file,
    "run_once_roots": q_run_once_roots,
    "index_versions": q_index_versions,
    "tree_scan": q_tree_scan,
    "bad_file_skip": q_bad_file_skip,
    "stream_live_upsert": q_stream_live_upsert,
    "stream_diagnostics": q_stream_diagnostics,
    "stream_periodic_refresh": q_stream_periodic_refresh,
    "stream_index": q_stream_index,
    "stream_index_diagnostics": q_stream_index_diagnostics,
    "stream_term_stats": q_stream_term_stats,
}


# ---------------------------------------------------------------- oracles
_PAGES = f"""
pg AS (SELECT page_id, url, regexp_extract(url, '{ROOT_RE}', 1) AS root FROM pages),
pg2 AS (SELECT *, CASE WHEN starts_with(url, root) THEN substr(url, length(root) + 1) ELSE url END AS rel_path FROM pg),
pg3 AS (SELECT *, list_filter(string_split(rel_path, '/'), lambda p: p <> '') AS parts FROM pg2)"""

SQL_PATH_FUNCTIONS = "WITH " + _PAGES + """
SELECT page_id, root, rel_path, array_to_string(parts, '|') AS parts, CAST(len(parts) AS BIGINT) AS n_parts,
       root || '/' || array_to_string(parts, '/') AS abs_user, '/' || array_to_string(parts, '/') AS abs_other,
       array_to_string(parts, '/') AS joined FROM pg3"""

SQL_USER_SPACE_FLAG = "WITH " + _PAGES + f"""
SELECT page_id, contains(url, {sp.q(WORKSPACE_HOST)}) AS user_space FROM pg3"""

SQL_FILE_KEYS = "WITH " + _PAGES + """
SELECT page_id, rel_path, sha256(rel_path) AS file_key FROM pg3"""

SQL_PRUNE_PATHS = "WITH " + _PAGES + f"""
SELECT page_id, rel_path FROM pg3
WHERE len(list_filter(list_slice(parts, 1, len(parts) - 1),
                      lambda d: {' OR '.join(f"contains(d, {sp.q(w)})" for w in PRUNE_WORDS)})) = 0"""

_LOCK = f"""
lock_lines AS (
  SELECT unnest(['    ' || e, '  ' || e, '      ' || e]) AS value
  FROM (SELECT replace(s_name, '#', '-') || ' (' || CAST(s_suppkey AS VARCHAR) || '.0)' AS e FROM supplier)),
entries AS (
  -- four blanks and no fifth, a name, and a version in brackets
  SELECT CASE WHEN value LIKE '    %(%)%' AND value NOT LIKE '     %' THEN split_part(value[5:], ' ', 1) ELSE '' END AS name,
         split_part(split_part(value, '(', 2), ')', 1) AS version FROM lock_lines),
deps AS (
  SELECT {sp.q(GEM_HOME + '/gems/')} || name || '-' || version AS root, TRUE AS interface_only, FALSE AS user_space
  FROM entries WHERE name <> ''
  UNION ALL SELECT {sp.q(STDLIB_ROOT)}, TRUE, FALSE)"""

SQL_LOCKFILE_DEPS = "WITH " + _LOCK + "\nSELECT name, version FROM entries WHERE name <> ''"
SQL_DEPENDENCY_ROOTS = "WITH " + _LOCK + "\nSELECT * FROM deps"

_INCLUDED = f"""
inc_dirs AS (
  SELECT CASE WHEN p_size % 2 = 0 THEN '/opt/vendor/' || lower(replace(p_brand, '#', '_'))
              ELSE 'lib/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) END AS path,
         CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 3 <> 0 END AS interface_only
  FROM part),
included AS (
  SELECT DISTINCT CASE WHEN starts_with(path, '/') THEN path ELSE {sp.q(WORKSPACE + '/')} || path END AS root,
         coalesce(interface_only, TRUE) AS interface_only, FALSE AS user_space FROM inc_dirs)"""

SQL_INCLUDED_ROOTS = "WITH " + _INCLUDED + "\nSELECT * FROM included"

_UNION = "WITH " + _PAGES + "," + _LOCK + "," + _INCLUDED + """,
src AS (
  SELECT DISTINCT * FROM (
    SELECT 'workspace' AS source, root, FALSE AS interface_only, TRUE AS user_space FROM pg3
    UNION ALL SELECT 'included', root, interface_only, user_space FROM included
    UNION ALL SELECT 'dependencies', root, interface_only, user_space FROM deps))"""

SQL_SOURCE_UNION = _UNION + "\nSELECT source, root, interface_only, user_space FROM src"
SQL_RUN_CONFIG = _UNION + """
SELECT source, CAST(count(*) AS BIGINT) AS n FROM src WHERE source <> 'dependencies' GROUP BY source
UNION ALL SELECT 'diagnostics', CAST(0 AS BIGINT)"""

_DIAG = "WITH " + sp.LINES.lstrip() + """,
dups AS (SELECT line_text FROM doc_line_pos WHERE line_len > 0 GROUP BY line_text HAVING count(*) > 1),
diags AS (
  SELECT doc_id AS file_id, line AS start_line, CAST(0 AS BIGINT) AS start_col, line AS end_line,
         line_len - 1 AS end_col, 'repeated line' AS message
  FROM doc_line_pos WHERE line_len > 0 AND line_text IN (SELECT line_text FROM dups))"""

SQL_DIAGNOSTICS = _DIAG + "\nSELECT * FROM diags"
SQL_DIAGNOSTICS_BY_FILE = _DIAG + """
SELECT file_id, CAST(count(*) AS BIGINT) AS n_messages,
       string_agg(CAST(start_line AS VARCHAR) || ':' || CAST(start_col AS VARCHAR) || ':' ||
                  CAST(end_line AS VARCHAR) || ':' || CAST(end_col AS VARCHAR), ';'
                  ORDER BY start_line, start_col, end_line, end_col, message) AS ranges
FROM diags GROUP BY file_id"""
SQL_DIAGNOSTICS_PAGES = SQL_DIAGNOSTICS_BY_FILE.replace("SELECT file_id, CAST(count", "SELECT file_id, start_line // 8 AS page, CAST(count").replace(
    "GROUP BY file_id", "GROUP BY file_id, start_line // 8")
SQL_DIAGNOSTICS_GATE = _DIAG + """
SELECT d.doc_id AS file_id, CAST(count(g.file_id) AS BIGINT) AS n_messages, count(g.file_id) = 0 AS indexed_strict,
       TRUE AS indexed_lenient
FROM documents d LEFT JOIN diags g ON g.file_id = d.doc_id GROUP BY d.doc_id"""

_REINDEX = "('view', 'click', 'purchase')"
SQL_LATEST_TEXT = f"""
SELECT user_id AS file_id, event_id AS version, props AS text, ts FROM events
WHERE event_type IN {_REINDEX}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""

SQL_CHANGED_FILES = """
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS pass_day FROM events)
SELECT DISTINCT d.pass_day, e.user_id AS file_id FROM days d JOIN events e
  ON e.ts >= CAST(d.pass_day AS TIMESTAMP) - INTERVAL 1 SECOND AND e.ts < CAST(d.pass_day + 1 AS TIMESTAMP)"""

SQL_DELETED_FILES = """
WITH f AS (SELECT DISTINCT user_id AS file_id, CAST(ts AS DATE) AS day FROM events),
days AS (SELECT DISTINCT day FROM f)
SELECT p.day + 1 AS pass_day, p.file_id FROM f p
WHERE p.day + 1 IN (SELECT day FROM days)
  AND NOT EXISTS (SELECT 1 FROM f c WHERE c.file_id = p.file_id AND c.day = p.day + 1)"""

SQL_SKIP_UNCHANGED = f"""
WITH s AS (SELECT CAST(floor(epoch(ts) / {FD.PASS_SECONDS}) * {FD.PASS_SECONDS} AS BIGINT) AS start_s FROM events),
counts AS (SELECT start_s, count(*) AS n FROM s GROUP BY start_s),
grid AS (SELECT unnest(range((SELECT min(start_s) FROM s), (SELECT max(start_s) FROM s) + 1, {FD.PASS_SECONDS})) AS start_s)
SELECT make_timestamp(g.start_s * 1000000) AS pass_start, CAST(coalesce(c.n, 0) AS BIGINT) AS n_changes,
       coalesce(c.n, 0) = 0 AS skipped
FROM grid g LEFT JOIN counts c ON c.start_s = g.start_s"""

SQL_REPLACE_BY_FILE = f"""
WITH f AS (SELECT user_id AS file_id, event_id AS version, event_type, props AS text, CAST(ts AS DATE) AS day FROM events),
last AS (SELECT max(day) AS d FROM f),
old_latest AS (SELECT file_id, text FROM f WHERE day < (SELECT d FROM last) AND event_type IN {_REINDEX}
               QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY version DESC) = 1),
new_latest AS (SELECT file_id, text FROM f WHERE day = (SELECT d FROM last) AND event_type IN {_REINDEX}
               QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY version DESC) = 1),
deleted AS (SELECT DISTINCT file_id FROM f WHERE day = (SELECT d FROM last) - 1
            AND file_id NOT IN (SELECT file_id FROM f WHERE day = (SELECT d FROM last))),
kept AS (SELECT * FROM old_latest WHERE file_id NOT IN (SELECT file_id FROM new_latest)
         AND file_id NOT IN (SELECT file_id FROM deleted)),
texts AS (SELECT * FROM kept UNION ALL SELECT * FROM new_latest)
SELECT file_id, CAST(unnest(range(len(string_split(text, ' ')))) AS BIGINT) AS tok_ix,
       unnest(string_split(text, ' ')) AS token FROM texts"""

SQL_RUN_ONCE_ROOTS = f"""
SELECT {sp.q(GEM_HOME + '/gems/')} || replace(s_name, '#', '-') || '-' || CAST(s_suppkey AS VARCHAR) || '.0' AS root,
       CASE WHEN s_acctbal >= 0 THEN 'done' ELSE 'pending' END AS status FROM supplier"""

SQL_INDEX_VERSIONS = "WITH ch AS (" + SQL_CHANGED_FILES.replace("WITH days", "WITH days0").replace(
    "FROM days d", "FROM days0 d") + "), de AS (" + SQL_DELETED_FILES + """),
c AS (SELECT pass_day, count(*) AS n FROM ch GROUP BY pass_day),
d AS (SELECT pass_day, count(*) AS n FROM de GROUP BY pass_day),
v AS (SELECT coalesce(c.pass_day, d.pass_day) AS pass_day, CAST(coalesce(c.n, 0) AS BIGINT) AS n_changed,
             CAST(coalesce(d.n, 0) AS BIGINT) AS n_deleted
      FROM c FULL OUTER JOIN d ON c.pass_day = d.pass_day)
SELECT CAST(row_number() OVER (ORDER BY pass_day) AS BIGINT) AS version, pass_day, n_changed, n_deleted
FROM v WHERE n_changed > 0 OR n_deleted > 0"""

_SKIPPED = ", ".join(sp.q(x) for x in fx.NODE_MODULES_SOURCES + fx.BAD_UTF8_SOURCES)
SQL_TREE_SCAN = f"""
SELECT lang, source, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars
FROM documents WHERE source NOT IN ({_SKIPPED}) GROUP BY lang, source"""

SQL_BAD_FILE_SKIP = f"""
SELECT DISTINCT lang, source FROM documents
WHERE source IN ({', '.join(sp.q(x) for x in fx.BAD_UTF8_SOURCES)})
  AND source NOT IN ({', '.join(sp.q(x) for x in fx.NODE_MODULES_SOURCES)})"""

SQL_STREAM_DIAGNOSTICS = """
SELECT user_id AS file_id, event_id AS version, 'parse failed' AS message FROM (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
WHERE event_type = 'error'"""

# the index of a batch rebuild from each file's last text that did not fail
SQL_STREAM_INDEX = "WITH documents AS (SELECT user_id AS doc_id, 'feed' AS lang, 'feed' AS source, props AS text FROM events "
SQL_STREAM_INDEX += f"""WHERE event_type IN {_REINDEX} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
""" + sp.symbols_cte()
SQL_STREAM_TERM_STATS = SQL_STREAM_INDEX + """
SELECT 'scope' AS field, term, CAST(count(*) AS BIGINT) AS df
FROM (SELECT unnest(list_distinct(scope_path)) AS term FROM symbols) GROUP BY term
UNION ALL SELECT 'node_type', node_type, CAST(count(*) AS BIGINT) FROM symbols GROUP BY node_type"""
SQL_STREAM_INDEX += """
SELECT file_id, seq, category, node_type, name, line, start_col, end_col FROM symbols"""
SQL_STREAM_INDEX_DIAGNOSTICS = """
SELECT user_id AS file_id, 0::BIGINT AS start_line, 0::BIGINT AS start_col,
       (length(props) - length(replace(props, chr(10), '')))::BIGINT AS end_line,
       length(string_split(props, chr(10))[-1])::BIGINT AS end_col, 'parse failed' AS message FROM (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
WHERE event_type = 'error'"""
SQL_STREAM_REFRESH = f"""
SELECT CAST(ts AS DATE) AS pass_day, count(DISTINCT user_id) AS n_changed FROM events
WHERE event_type IN {_REINDEX} GROUP BY 1"""

ORACLES = {
    "path_functions": SQL_PATH_FUNCTIONS,
    "user_space_flag": SQL_USER_SPACE_FLAG,
    "file_keys": SQL_FILE_KEYS,
    "prune_paths": SQL_PRUNE_PATHS,
    "lockfile_deps": SQL_LOCKFILE_DEPS,
    "dependency_roots": SQL_DEPENDENCY_ROOTS,
    "included_roots": SQL_INCLUDED_ROOTS,
    "source_union": SQL_SOURCE_UNION,
    "run_config": SQL_RUN_CONFIG,
    "diagnostics": SQL_DIAGNOSTICS,
    "diagnostics_by_file": SQL_DIAGNOSTICS_BY_FILE,
    "diagnostics_pages": SQL_DIAGNOSTICS_PAGES,
    "diagnostics_gate": SQL_DIAGNOSTICS_GATE,
    "latest_text_per_file": SQL_LATEST_TEXT,
    "changed_files": SQL_CHANGED_FILES,
    "deleted_files": SQL_DELETED_FILES,
    "skip_unchanged": SQL_SKIP_UNCHANGED,
    "replace_by_file": SQL_REPLACE_BY_FILE,
    "run_once_roots": SQL_RUN_ONCE_ROOTS,
    "index_versions": SQL_INDEX_VERSIONS,
    "tree_scan": SQL_TREE_SCAN,
    "bad_file_skip": SQL_BAD_FILE_SKIP,
    "stream_live_upsert": SQL_LATEST_TEXT,
    "stream_diagnostics": SQL_STREAM_DIAGNOSTICS,
    "stream_periodic_refresh": SQL_STREAM_REFRESH,
    "stream_index": SQL_STREAM_INDEX,
    "stream_index_diagnostics": SQL_STREAM_INDEX_DIAGNOSTICS,
    "stream_term_stats": SQL_STREAM_TERM_STATS,
}
