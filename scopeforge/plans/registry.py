"""All registered queries and their SQL oracles."""

from __future__ import annotations

from . import extract_queries, io_queries, pass_queries, program_queries, search_queries

_FAMILIES = [search_queries, extract_queries, io_queries, pass_queries, program_queries]


def all_queries():
    q = {}
    for fam in _FAMILIES:
        q.update(fam.QUERIES)
    return q


def all_oracles():
    o = {}
    for fam in _FAMILIES:
        o.update(fam.ORACLES)
    return o
