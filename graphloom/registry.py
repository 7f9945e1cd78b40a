"""Named queries of the graph engine and their reference SQL."""

from __future__ import annotations

from graphloom.catalog import changes, extract, graph, search, service, tables

_MODULES = (graph, tables, search, extract, service, changes)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
