"""Registered queries of the search family (Q-*, AGG-1) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators import search as S
from ..operators.stats import field_stats, term_stats
from ..sources import fixtures as fx
from . import sqlparts as sp
from .index import bucketed_index, definition_groups, index_stats, symbol_index

ROOT = S.DEFAULT_ROOT
PATTERN_PLAIN = "th"
PATTERN_REGEX = "(de|qu)[ae]"

# Probe branches of definition search: usage types that reach each scope rule.
DEF_BRANCHES = {
    "definitions_const": ("node_type = 'Const'", lambda: F.col("node_type") == "Const"),
    "definitions_local": ("node_type = 'Lvar'", lambda: F.col("node_type") == "Lvar"),
    "definitions_send_scoped": ("node_type = 'Send' AND len(class_scope) > 0",
                                lambda: (F.col("node_type") == "Send") & (F.size("class_scope") > 0)),
    "definitions_send_plain": ("node_type = 'Send' AND len(class_scope) = 0",
                               lambda: (F.col("node_type") == "Send") & (F.size("class_scope") == 0)),
    "definitions_other": ("node_type IN ('Alias', 'CSend', 'Cvar', 'Gvar', 'Ivar', 'Super', 'ZSuper')",
                          lambda: F.col("node_type").isin("Alias", "CSend", "Cvar", "Gvar", "Ivar", "Super",
                                                          "ZSuper")),
}


# ---------------------------------------------------------------- probes
def line_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probe per document line, at a column that walks over tokens, blanks and
    one past the end: col = (doc_id + 7 * line) mod (line_len + 2)."""
    lines = fx.document_lines(fx.table(spark, sf_dir, "documents"))
    return lines.select(
        (F.col("doc_id") * F.lit(1 << 32) + F.col("line")).alias("probe_id"),
        F.col("doc_id").alias("file_id"), "line",
        ((F.col("doc_id") + F.lit(7) * F.col("line")) % (F.col("line_len") + 2)).alias("col"))


LINE_PROBES_SQL = """
probes AS (
  SELECT doc_id * 4294967296 + line AS probe_id, doc_id AS file_id, line,
         (doc_id + 7 * line) % (line_len + 2) AS col
  FROM doc_line_pos)"""


#: The query set of the searches: every symbol (or usage) of the files whose id is
#: divisible by this number, searched in all symbols of all files.
QUERY_FILES = 50


def _probe_files(index: DataFrame) -> DataFrame:
    return index.filter(F.col("file_id") % QUERY_FILES == 0).withColumn(
        "probe_id", F.concat_ws(":", "file_id", "seq"))


def usage_probes(index: DataFrame, pred) -> DataFrame:
    """A probe on every usage of a branch's types in the query files."""
    return _probe_files(index.filter((F.col("category") == "usage") & pred)).select(
        "probe_id", "file_id", "line", F.col("start_col").alias("col"))


def symbol_probes(index: DataFrame) -> DataFrame:
    """A probe on every symbol of the query files, with a new name for the rename."""
    return _probe_files(index).select("probe_id", "file_id", "line", F.col("start_col").alias("col"),
                                      F.concat(F.lit("renamed_"), "name").alias("new_name"))


def _refs(spark, sf_dir):
    idx, buckets = bucketed_index(spark, sf_dir)
    stats = index_stats(spark, sf_dir)
    return S.find_references(spark, symbol_probes(idx), idx, stats, buckets=buckets)


# ---------------------------------------------------------------- queries
def q_symbol_search(spark, sf_dir, pattern=PATTERN_PLAIN):
    idx = symbol_index(spark, sf_dir)
    return S.workspace_symbols(idx, index_stats(spark, sf_dir), pattern, ROOT)


def q_symbol_search_regex(spark, sf_dir):
    return q_symbol_search(spark, sf_dir, PATTERN_REGEX)


def q_point_lookup_usage(spark, sf_dir):
    idx, buckets = bucketed_index(spark, sf_dir)
    u = S.point_lookup(line_probes(spark, sf_dir), idx, usage_only=True, buckets=buckets)
    return u.select("probe_id", F.col("u_seq").alias("seq"), F.col("u_name").alias("name"),
                    F.col("u_node_type").alias("node_type"), F.col("u_start_col").alias("start_col"),
                    F.col("u_end_col").alias("end_col"))


def q_point_lookup_any(spark, sf_dir):
    idx, buckets = bucketed_index(spark, sf_dir)
    u = S.point_lookup(line_probes(spark, sf_dir), idx, usage_only=False, buckets=buckets)
    return u.select("probe_id", F.col("u_seq").alias("seq"), F.col("u_name").alias("name"),
                    F.col("u_category").alias("category"), F.col("u_start_col").alias("start_col"),
                    F.col("u_end_col").alias("end_col"))


def _definitions(branch):
    def run(spark, sf_dir):
        idx, buckets = bucketed_index(spark, sf_dir)
        stats = index_stats(spark, sf_dir)
        probes = usage_probes(idx, DEF_BRANCHES[branch][1]())
        hits = S.find_definitions(spark, probes, idx, stats,
                                  groups=definition_groups(spark, sf_dir, rules.DEFINITION_LIMIT), buckets=buckets)
        return hits.select("probe_id", "rank", S.absolute_path("path_parts", "user_space", ROOT).alias("path"),
                           "name", "node_type", "line", "start_col", "end_col", F.round("score", 6).alias("score"))
    return run


def q_references(spark, sf_dir):
    r = _refs(spark, sf_dir)
    return r.select("probe_id", "rank", "file_id", "name", "node_type", "category", "line",
                    "start_col", "end_col", F.round("score", 6).alias("score"))


def q_highlights(spark, sf_dir):
    return S.highlights(_refs(spark, sf_dir))


def q_reference_locations(spark, sf_dir):
    return S.locations(_refs(spark, sf_dir), ROOT)


def q_rename_edits(spark, sf_dir):
    return S.rename_edits(_refs(spark, sf_dir), ROOT)


def q_rename_edits_by_file(spark, sf_dir):
    return S.rename_edits_by_file(S.rename_edits(_refs(spark, sf_dir), ROOT))


def q_term_stats(spark, sf_dir):
    return term_stats(symbol_index(spark, sf_dir))


def q_field_stats(spark, sf_dir):
    return field_stats(symbol_index(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 6))


QUERIES = {
    "symbol_search": q_symbol_search,
    "symbol_search_regex": q_symbol_search_regex,
    "point_lookup_usage": q_point_lookup_usage,
    "point_lookup_any": q_point_lookup_any,
    **{k: _definitions(k) for k in DEF_BRANCHES},
    "references": q_references,
    "highlights": q_highlights,
    "reference_locations": q_reference_locations,
    "rename_edits": q_rename_edits,
    "rename_edits_by_file": q_rename_edits_by_file,
    "term_stats": q_term_stats,
    "field_stats": q_field_stats,
}


# ---------------------------------------------------------------- oracles
def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _abs_path(alias="") -> str:
    a = alias + "." if alias else ""
    return (f"CASE WHEN {a}user_space THEN {sp.q(ROOT)} || '/' || array_to_string({a}path_parts, '/') "
            f"ELSE '/' || array_to_string({a}path_parts, '/') END")


def sql_symbol_search(pattern=PATTERN_PLAIN, regex=False):
    match = (f"regexp_full_match(s.name, {sp.q(pattern + '.*')})" if regex
             else f"starts_with(s.name, {sp.q(pattern)})")
    return _with(sp.symbols_cte(), sp.STATS) + f"""
SELECT row_number() OVER (ORDER BY score DESC, file_id, line, start_col, seq) AS rank,
       name, kind, path, line AS start_line, start_col, line AS end_line, end_col, round(score, 6) AS score
FROM (
  SELECT s.*, round(t.idf, 9) AS score,
         CASE WHEN s.node_type[:3] IN ('Ali', 'Def') THEN 'METHOD' WHEN s.node_type = 'Module' THEN 'MODULE'
              WHEN s.node_type = 'Gvasgn' THEN 'VARIABLE' ELSE 'CLASS' END AS kind,
         {sp.q(ROOT)} || '/' || array_to_string(s.path_parts, '/') AS path
  FROM symbols s JOIN type_idf t ON t.term = s.node_type
  WHERE s.user_space AND s.node_type IN ('Alias', 'Def', 'Defs', 'Casgn', 'Class', 'Module', 'Gvasgn') AND {match}
  ORDER BY score DESC, file_id, line, start_col, seq
  LIMIT 100)"""


def _lookup_sql(usage_only: bool) -> str:
    cat = "AND s.category = 'usage'" if usage_only else ""
    return f"""
u AS (
  SELECT p.*, s.seq AS u_seq, s.name AS u_name, s.node_type AS u_node_type, s.category AS u_category,
         s.scope_path AS u_scope_path, s.class_scope AS u_class_scope,
         s.start_col AS u_start_col, s.end_col AS u_end_col
  FROM probes p JOIN symbols s
    ON s.file_id = p.file_id AND s.line = p.line AND p.col BETWEEN s.start_col AND s.end_col {cat}
  QUALIFY row_number() OVER (PARTITION BY p.probe_id
          ORDER BY s.end_col - s.start_col, s.start_col, s.seq) = 1)"""


def sql_point_lookup(usage_only: bool):
    third = "u_node_type AS node_type" if usage_only else "u_category AS category"
    return _with(sp.symbols_cte(), LINE_PROBES_SQL, _lookup_sql(usage_only)) + f"""
SELECT probe_id, u_seq AS seq, u_name AS name, {third}, u_start_col AS start_col, u_end_col AS end_col FROM u"""


def _scored_sql(clauses_sql: str, directions, category_pred: str, file_pred: str, required_pred: str,
                limit: int) -> str:
    """Candidates, required-scope filter, score and top-k, for the probe set ``u``."""
    return f""",
clauses AS ({clauses_sql}),
cw AS (SELECT c.probe_id, c.term, c.boost * coalesce(i.idf, 0) AS w
       FROM clauses c LEFT JOIN scope_idf i ON i.term = c.term),
allowed AS ({sp.type_rules_sql(directions)}),
cand AS (
  SELECT u.probe_id, d.*, a.multiplicity, t.idf AS type_idf
  FROM u JOIN allowed a ON a.probe_type = u.u_node_type
  JOIN symbols d ON d.name = u.u_name AND d.node_type = a.match_type {category_pred} {file_pred}
  LEFT JOIN type_idf t ON t.term = d.node_type
  WHERE {required_pred}),
scored AS (
  SELECT cand.*, round(multiplicity * coalesce(type_idf, 0) + {sp.length_norm('len(scope_path)')} *
         coalesce((SELECT sum(cw.w) FROM cw WHERE cw.probe_id = cand.probe_id
                   AND list_contains(cand.scope_path, cw.term)), 0), 9) AS score
  FROM cand),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, file_id, line, start_col, seq) AS rank
  FROM scored QUALIFY rank <= {limit})"""


def _usage_probes_sql(pred: str) -> str:
    return f"""
probes AS (
  SELECT file_id::VARCHAR || ':' || seq::VARCHAR AS probe_id, file_id, line, start_col AS col FROM symbols
  WHERE category = 'usage' AND file_id % {QUERY_FILES} = 0 AND {pred})"""


def sql_definitions_of(pred: str, symbols: str) -> str:
    """The ranked definitions of every usage of the query files that ``pred`` takes."""
    local = ", ".join(sp.q(t) for t in [*sp.LOCALS, "Lvar"])
    boost = 10000.0
    clauses = f"""
  SELECT probe_id, unnest(u_class_scope) AS term, 1.0 AS boost FROM u WHERE u_node_type = 'Const'
  UNION ALL SELECT probe_id, unnest(u_scope_path), 1.0 FROM u WHERE u_node_type = 'Const'
  UNION ALL SELECT probe_id, unnest(u_scope_path), 1.0 FROM u WHERE u_node_type IN ({local})
  UNION ALL SELECT probe_id, unnest(u_class_scope), {boost} FROM u
            WHERE u_node_type = 'Send' AND len(u_class_scope) > 0
  UNION ALL SELECT probe_id, unnest(u_scope_path), 1.0 FROM u
            WHERE u_node_type NOT IN ('Const', {local}) AND NOT (u_node_type = 'Send' AND len(u_class_scope) > 0)"""
    required = f"""CASE WHEN u.u_node_type = 'Const' THEN list_has_all(d.scope_path, u.u_class_scope)
       WHEN u.u_node_type IN ({local}) THEN list_has_all(d.scope_path, u.u_scope_path)
       WHEN u.u_node_type = 'Send' AND len(u.u_class_scope) > 0 THEN list_has_all(d.scope_path, u.u_class_scope)
       ELSE TRUE END"""
    return _with(symbols, sp.STATS, _usage_probes_sql(pred), _lookup_sql(True)) + _scored_sql(
        clauses, ("usage",), "AND d.category = 'assignment'", "", required, 50)


def sql_definitions(branch: str) -> str:
    return sql_definitions_of(DEF_BRANCHES[branch][0], sp.symbols_cte()) + f"""
SELECT probe_id, rank, {_abs_path()} AS path, name, node_type, line, start_col, end_col, round(score, 6) AS score FROM ranked"""


REF_PROBES_SQL = f"""
probes AS (
  SELECT file_id::VARCHAR || ':' || seq::VARCHAR AS probe_id, file_id, line, start_col AS col,
         'renamed_' || name AS new_name
  FROM symbols WHERE file_id % {QUERY_FILES} = 0)"""


def _refs_sql() -> str:
    return sql_references_of(sp.symbols_cte())


def sql_references_of(symbols: str) -> str:
    """The ranked references of every symbol of the query files."""
    local = ", ".join(sp.q(t) for t in [*sp.LOCALS, "Lvar"])
    clauses = "SELECT probe_id, unnest(u_scope_path) AS term, 1.0 AS boost FROM u"
    required = f"(u.u_node_type NOT IN ({local}) OR list_has_all(d.scope_path, u.u_scope_path))"
    return _with(symbols, sp.STATS, REF_PROBES_SQL, _lookup_sql(False)) + _scored_sql(
        clauses, ("usage", "assignment"), "", "AND d.file_id = u.file_id", required, 100)


def sql_references():
    return _refs_sql() + """
SELECT probe_id, rank, file_id, name, node_type, category, line, start_col, end_col, round(score, 6) AS score FROM ranked"""


def sql_highlights():
    return _refs_sql() + """
SELECT probe_id, rank, line, start_col, end_col,
       CASE WHEN category = 'assignment' THEN 'WRITE' ELSE 'READ' END AS kind FROM ranked"""


def sql_reference_locations():
    return _refs_sql() + f"""
SELECT probe_id, rank, {_abs_path()} AS path, line AS start_line, start_col, line AS end_line, end_col FROM ranked"""


def _rename_sql():
    return _refs_sql() + f""",
edits AS (
  SELECT r.probe_id, r.rank, {_abs_path('r')} AS path, r.line, r.start_col, r.end_col, p.new_name AS new_text
  FROM ranked r JOIN probes p ON p.probe_id = r.probe_id)"""


def sql_rename_edits():
    return _rename_sql() + "\nSELECT * FROM edits"


def sql_rename_edits_by_file():
    return _rename_sql() + """
SELECT probe_id, path, CAST(count(*) AS BIGINT) AS n_edits,
       string_agg(CAST(line AS VARCHAR) || ':' || CAST(start_col AS VARCHAR) || ':' ||
                  CAST(end_col AS VARCHAR) || ':' || new_text, ';'
                  ORDER BY line, start_col, end_col, new_text) AS edits
FROM edits GROUP BY probe_id, path"""


def sql_term_stats():
    return _with(sp.symbols_cte()) + """
SELECT 'scope' AS field, term, CAST(count(*) AS BIGINT) AS df
FROM (SELECT unnest(list_distinct(scope_path)) AS term FROM symbols) GROUP BY term
UNION ALL
SELECT 'node_type', node_type, CAST(count(*) AS BIGINT) FROM symbols GROUP BY node_type"""


def sql_field_stats():
    return _with(sp.symbols_cte()) + """
SELECT 'scope' AS field, CAST(count(*) AS BIGINT) AS n_docs, round(avg(len(scope_path)), 6) AS avg_len FROM symbols"""


ORACLES = {
    "symbol_search": sql_symbol_search(),
    "symbol_search_regex": sql_symbol_search(PATTERN_REGEX, regex=True),
    "point_lookup_usage": sql_point_lookup(True),
    "point_lookup_any": sql_point_lookup(False),
    **{k: sql_definitions(k) for k in DEF_BRANCHES},
    "references": sql_references(),
    "highlights": sql_highlights(),
    "reference_locations": sql_reference_locations(),
    "rename_edits": sql_rename_edits(),
    "rename_edits_by_file": sql_rename_edits_by_file(),
    "term_stats": sql_term_stats(),
    "field_stats": sql_field_stats(),
}
