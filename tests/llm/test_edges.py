"""Every query on edge cases and on empty tables, and the defined results of the cases."""

import pytest

from scopeforge.llm.registry import QUERIES

ROWS = {"op9_wrapper_html": 7, "op3_tool_calls": 10, "op11_angular_negatives": 7, "op13_whitening": 24}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_rows(spark, edge_dir, name):
    assert QUERIES[name](spark, edge_dir).count() == ROWS.get(name, 13)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


def rows(spark, edge_dir, name):
    return QUERIES[name](spark, edge_dir).collect()


def test_pipeline_on_edges(spark, edge_dir, empty_dir):
    import corpus_pipeline
    kept = {r.doc_id for r in corpus_pipeline.run(spark, edge_dir).collect()}
    assert kept and not kept & {0, 1, 2}
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_repeated_ids_and_clashing_names_in_the_pipeline(spark):
    """A near copy goes although its id has another text, too; columns of any name stay."""
    import corpus_pipeline
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(6, long), (7, long + " z"), (7, "other words of this id"), (7, "third text, not like the others at all"),
            (8, ""), (8, "eight"), (None, long), (9, "twice the same"), (9, "twice the same")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "c", "c", "c") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, _th string, _kept string, th string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted(
        (str(i), t) for i, t in dict.fromkeys(rows) if (i, t) != (7, long + " z"))
    assert corpus_pipeline.repeated_passages(spark, got, "").columns == docs.columns
    assert corpus_pipeline.mix(spark, got, "").columns == docs.columns


def test_empty_texts_have_only_the_end_id(spark, edge_dir):
    n = {r.doc_id: r.n_tokens for r in rows(spark, edge_dir, "op1_sentencepiece")}
    assert n[0] == n[1] == 1


def test_near_duplicates_and_wordless_texts(spark, edge_dir):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in rows(spark, edge_dir, "op8_signature_tree")}
    assert got[0, 0] == 0 and got[1, 0] == 1 and got[2, 0] == 2
    assert got[3, 1] == 3
    assert got[5, 59] == 4 and got[4, 59] == 4  # 58 of 60 shingles
    assert min(c for (d, n), c in got.items() if d == 7 and n > 100) == 6


def test_repeated_passage_goes_from_the_later_document(spark, edge_dir):
    got = {(r.doc_id, r.n_words): r.n_removed for r in rows(spark, edge_dir, "op4_fm_substring")}
    assert got[4, 61] == 0 and got[5, 61] == 60 and got[None, 60] == 0
    assert got[6, 30_000] == 0 and got[7, 30_001] == 30_000


def test_tool_call_states(spark, edge_dir):
    got = sorted((str(r.conv_id), str(r.turn), r.kind, r.status) for r in rows(spark, edge_dir, "op3_tool_calls"))
    assert ("0", "0", "call", "invalid_json") in got
    assert ("0", "1", "result", "ok") in got
    assert [g[3] for g in got if g[:3] == ("1", "0", "call")] == ["duplicate_call", "ok"]
    assert ("2", "1", "result", "orphan_result") in got
    assert ("4", "0", "message", "ok") in got and ("4", "1", "result", "orphan_result") in got  # system and tool turns


def test_pages(spark, edge_dir):
    got = {(r.page_id, r.url): r.text for r in rows(spark, edge_dir, "op9_wrapper_html")}
    assert got[2, "http://h.x/b"] == "A & B\none two"
    assert got[0, None] == "" and got[1, "http://h.x/a"] == "" and got[None, "no url"] == "q"
    assert got[5, "http://h.x/d"].startswith("A & B\nx x x")
