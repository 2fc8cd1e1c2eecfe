"""The large-probe-table path of search (no broadcast, salted hot keys) returns
exactly what the broadcast path returns."""

import scopeforge.operators.search as S
from scopeforge.plans import search_queries as SQ

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_salted_definitions_equal_broadcast(spark, monkeypatch):
    q = SQ.QUERIES["definitions_send_plain"]
    want = _rows(q(spark, SF))
    monkeypatch.setattr(S, "BROADCAST_MAX_ROWS", 0)
    monkeypatch.setattr(S, "SALT_MIN_ROWS", 5)
    got = _rows(q(spark, SF))
    assert got == want and len(got) > 0


def test_salted_references_equal_broadcast(spark, monkeypatch):
    q = SQ.QUERIES["references"]
    want = _rows(q(spark, SF))
    monkeypatch.setattr(S, "BROADCAST_MAX_ROWS", 0)
    monkeypatch.setattr(S, "SALT_MIN_ROWS", 5)
    got = _rows(q(spark, SF))
    assert got == want and len(got) > 0


def test_salted_duplicate_lines_equal_plain(spark, monkeypatch):
    import scopeforge.plans.io_queries as IO
    want = _rows(IO.q_diagnostics(spark, SF))
    monkeypatch.setattr(IO, "SALT_MIN_ROWS", 2)
    got = _rows(IO.q_diagnostics(spark, SF))
    assert got == want and len(got) > 0
