"""Registered queries: each composes operators over the given tables, with the SQL that it must equal."""

from __future__ import annotations

from tidemark.plans import changes, overview, pages, reports, scores, search, sites, states, streams, usage

_MODULES = (changes, scores, pages, sites, states, search, usage, reports, overview, streams)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
