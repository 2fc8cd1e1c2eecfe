"""SQL building blocks for the DuckDB oracles (reference answers for tests).

They restate the fixture mapping and each operator in plain SQL, written
independently of the Spark plans (window sums instead of in-row positions,
correlated subqueries instead of in-row scoring).
"""

from __future__ import annotations

from .. import rules
from ..sources.fixtures import CLASS_SCOPE_SLOTS, DOC_TOKEN_KINDS, SEQ_LINE_SHIFT


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def values(rows, cols) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return q(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


#: What a node emits, stated here a second time and in another form, so that a wrong row
#: of the engine's rules shows.
_ASSIGNMENTS = """Arg Casgn Class Cvasgn Def Defs Gvasgn Ivasgn Kwarg Kwoptarg Kwrestarg Lvasgn MatchVar Module Optarg
Restarg Shadowarg""".split()
_USAGES = "Const CSend Cvar Gvar Ivar Lvar Send Super ZSuper".split()


def emit_rules_sql() -> str:
    rows = [(k, "*", "assignment", k) for k in _ASSIGNMENTS] + [(k, "*", "usage", k) for k in _USAGES]
    rows += [("Sym", "*", "usage", "Send"), ("Alias", "to", "assignment", "Alias"), ("Alias", "from", "usage", "Alias")]
    return f"SELECT * FROM {values(rows, ['kind', 'slot', 'category', 'node_type'])}"


#: Which types meet, stated by families and not by the engine's maps.
_CALLS = "CSend Send Super ZSuper".split()
_CONSTANTS = "Casgn Class Module".split()
LOCALS = "Arg Kwarg Kwoptarg Kwrestarg Lvasgn MatchVar Optarg Restarg Shadowarg".split()


def type_rules_sql(directions=("usage",)) -> str:
    rows = []
    if "usage" in directions:
        rows += [(p, m) for p in [*_CALLS, "Alias"] for m in [*_CALLS, "Alias", "Def", "Defs"]]
        rows += [("Const", m) for m in [*_CONSTANTS, "Const"]] + [("Lvar", m) for m in [*LOCALS, "Lvar"]]
        rows += [(f"{v}var", f"{v}{m}") for v in "CGI" for m in ("var", "vasgn")]
    if "assignment" in directions:
        rows += [(p, m) for p in ("Alias", "Def", "Defs") for m in [*_CALLS, "Alias"]]
        rows += [("Alias", "Def"), ("Alias", "Defs"), ("Def", "Def"), ("Defs", "Defs")]
        rows += [(p, m) for p in _CONSTANTS for m in [*_CONSTANTS, "Const"]] + [(p, m) for p in LOCALS for m in [*LOCALS, "Lvar"]]
        rows += [(f"{v}vasgn", f"{v}{m}") for v in "CGI" for m in ("var", "vasgn")]
    return (f"SELECT probe_type, match_type, count(*) AS multiplicity FROM "
            f"{values(rows, ['probe_type', 'match_type'])} GROUP BY ALL")


#: Definitions that class-level macros make, by the language's rules: a reader, a writer, or both.
MACROS_SQL = """
SELECT 'attr_' || m AS method, 'all' AS arg_policy, FALSE AS allow_str, s AS suffix
FROM (VALUES ('reader', ''), ('writer', '='), ('accessor', ''), ('accessor', '=')) AS t(m, s)
UNION ALL SELECT 'alias_method', 'first', TRUE, ''
UNION ALL SELECT unnest(['belongs_to', 'has_one', 'has_many', 'has_and_belongs_to_many']), 'first', FALSE, ''"""


LINES = """
doc_lines AS (
  SELECT doc_id, lang, source, unnest(ls) AS line_text, unnest(range(len(ls))) AS line
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents)),
doc_line_pos AS (
  SELECT doc_id, CAST(line AS BIGINT) AS line, line_text, CAST(length(line_text) AS BIGINT) AS line_len,
         CAST(coalesce(sum(length(line_text) + 1) OVER (PARTITION BY doc_id ORDER BY line
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start
  FROM doc_lines)"""


def symbols_cte() -> str:
    kinds = str_list(DOC_TOKEN_KINDS)
    cs = ", ".join(str(x) for x in CLASS_SCOPE_SLOTS)
    return LINES + f""",
doc_toks AS (
  SELECT doc_id, lang, source, line, unnest(ts) AS tok, unnest(range(len(ts))) AS tok_ix
  FROM (SELECT doc_id, lang, source, CAST(line AS BIGINT) AS line, string_split(line_text, ' ') AS ts FROM doc_lines)),
tok_nodes AS (
  SELECT doc_id AS file_id, line * {SEQ_LINE_SHIFT} + tok_ix AS seq,
         [source, lang, CAST(doc_id AS VARCHAR)] AS path_parts,
         {kinds}[tok_ix % {len(DOC_TOKEN_KINDS)} + 1] AS kind,
         CASE WHEN line = 0 THEN [lang, source] ELSE [lang, source, 'm' || CAST(line % 3 AS VARCHAR)] END AS scope_path,
         CASE WHEN tok_ix % {len(DOC_TOKEN_KINDS)} IN ({cs}) THEN [source] ELSE CAST([] AS VARCHAR[]) END AS class_scope,
         lower(regexp_replace(tok, '[.,]+$', '')) AS name, line,
         CAST(coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id, line ORDER BY tok_ix
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_col,
         CAST(length(tok) AS BIGINT) AS tok_len,
         doc_id % 10 <> 0 AS user_space
  FROM doc_toks),
emit_rules AS ({emit_rules_sql()}),
symbols AS (
  SELECT n.file_id, n.seq, n.path_parts, r.category, n.scope_path, n.class_scope, n.name, r.node_type,
         n.line, n.start_col, n.start_col + n.tok_len AS end_col, n.user_space
  FROM tok_nodes n JOIN emit_rules r
    ON r.kind = n.kind AND (r.slot = '*' OR r.slot = CASE WHEN n.line % 2 = 0 THEN 'to' ELSE 'from' END)
  WHERE n.name IS NOT NULL AND n.name <> '')"""


STATS = """
sym_stats AS (SELECT count(*) AS n_docs, avg(len(scope_path)) AS avg_len FROM symbols),
scope_terms AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(scope_path)) AS term FROM symbols) GROUP BY term),
scope_idf AS (
  SELECT term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM scope_terms, sym_stats),
type_idf AS (
  SELECT node_type AS term, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM symbols, sym_stats GROUP BY node_type, n_docs)"""


def length_norm(len_expr: str) -> str:
    k1, b = rules.BM25_K1, rules.BM25_B
    return (f"({1 + k1} / (1 + {k1} * ({1 - b} + {b} * {len_expr} / "
            f"(SELECT CASE WHEN avg_len > 0 THEN avg_len ELSE 1 END FROM sym_stats))))")
