"""All queries of the engine by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from . import queries, scenes, table_queries

_MODULES = (queries, table_queries, scenes)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
