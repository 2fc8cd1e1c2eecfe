"""Golden case (FIXTURES.md §3): hand-checked symbol rows of a small Ruby file and
the expected answers of the search operators on them."""

from pyspark.sql import functions as F

from scopeforge.operators import search as S
from scopeforge.operators.stats import score_stats

# seq, category, type, name, scope_path, class_scope, line, start, end
GOLDEN = [
    (0, "assignment", "Module", "Shop", [], [], 0, 7, 11),
    (1, "assignment", "Class", "Cart", ["Shop"], [], 1, 8, 12),
    (2, "usage", "Const", "Base", ["Shop", "Cart"], [], 1, 15, 19),
    (3, "usage", "Send", "attr_accessor", ["Shop", "Cart"], [], 2, 4, 17),
    (4, "usage", "Send", "total", ["Shop", "Cart"], [], 2, 18, 24),
    (5, "assignment", "Def", "total", ["Shop", "Cart"], [], 2, 18, 24),
    (6, "assignment", "Def", "total=", ["Shop", "Cart"], [], 2, 18, 24),
    (7, "assignment", "Def", "add", ["Shop", "Cart"], [], 3, 8, 11),
    (8, "assignment", "Arg", "item", ["Shop", "Cart", "add"], [], 3, 12, 16),
    (9, "assignment", "Lvasgn", "price", ["Shop", "Cart", "add"], [], 4, 6, 11),
    (10, "usage", "Lvar", "item", ["Shop", "Cart", "add"], [], 4, 14, 18),
    (11, "usage", "Send", "cost", ["Shop", "Cart", "add"], [], 4, 19, 23),
    (12, "usage", "Const", "Rate", ["Shop", "Cart", "add"], ["Tax"], 5, 11, 15),
    (13, "usage", "Const", "Tax", ["Shop", "Cart", "add"], [], 5, 6, 9),
    (14, "usage", "Send", "apply", ["Shop", "Cart", "add"], ["Rate", "Tax"], 5, 16, 21),
    (15, "usage", "Lvar", "price", ["Shop", "Cart", "add"], [], 5, 22, 27),
]
SCHEMA = ("seq bigint, category string, node_type string, name string, scope_path array<string>, "
          "class_scope array<string>, line bigint, start_col bigint, end_col bigint")


def _index(spark):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    return df.select(F.lit(1).cast("bigint").alias("file_id"), "*",
                     F.array(F.lit("app"), F.lit("cart.rb")).alias("path_parts"),
                     F.lit(True).alias("user_space"))


def _probe(spark, line, col, new_name=None):
    return spark.createDataFrame([(1, 1, line, col, new_name)],
                                 "probe_id bigint, file_id bigint, line bigint, col bigint, new_name string")


def test_definition_of_local_variable(spark):
    idx = _index(spark)
    hits = S.find_definitions(spark, _probe(spark, 5, 23), idx, score_stats(idx)).collect()
    assert [(h.name, h.node_type, h.line, h.start_col, h.end_col) for h in hits] == [("price", "Lvasgn", 4, 6, 11)]


def test_definition_of_argument(spark):
    idx = _index(spark)
    hits = S.find_definitions(spark, _probe(spark, 4, 15), idx, score_stats(idx)).collect()
    assert [(h.name, h.node_type, h.line, h.start_col, h.end_col) for h in hits] == [("item", "Arg", 3, 12, 16)]


def test_definition_needs_receiver_scope(spark):
    idx = _index(spark)
    assert S.find_definitions(spark, _probe(spark, 5, 17), idx, score_stats(idx)).count() == 0


def test_highlights_and_rename(spark):
    idx = _index(spark)
    refs = S.find_references(spark, _probe(spark, 4, 7, "cost_net"), idx, score_stats(idx))
    hl = sorted((r.line, r.start_col, r.end_col, r.kind) for r in S.highlights(refs).collect())
    assert hl == [(4, 6, 11, "WRITE"), (5, 22, 27, "READ")]
    edits = sorted((e.line, e.start_col, e.end_col, e.new_text) for e in S.rename_edits(refs).collect())
    assert edits == [(4, 6, 11, "cost_net"), (5, 22, 27, "cost_net")]
    grouped = S.rename_edits_by_file(S.rename_edits(refs)).collect()
    assert len(grouped) == 1 and grouped[0].n_edits == 2


def test_workspace_symbol_search(spark):
    idx = _index(spark)
    st = score_stats(idx)
    to = sorted((r.name, r.kind) for r in S.workspace_symbols(idx, st, "to").collect())
    assert to == [("total", "METHOD"), ("total=", "METHOD")]
    assert [(r.name, r.kind) for r in S.workspace_symbols(idx, st, "Ca").collect()] == [("Cart", "CLASS")]
    assert S.workspace_symbols(idx, st, "ca").count() == 0
