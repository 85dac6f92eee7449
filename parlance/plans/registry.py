"""All registered queries over the test tables, and their SQL."""

from __future__ import annotations

from . import interval_queries, model_queries, role_queries, stat_queries, table_queries

_MODULES = (interval_queries, stat_queries, table_queries, role_queries, model_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
