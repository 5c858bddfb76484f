"""Registry of the engine's queries and of their SQL twins."""

from __future__ import annotations

from weftgraph.plans import corpus_queries, graph_queries, language_queries, sink_queries, source_queries, view_queries

_MODULES = (graph_queries, corpus_queries, sink_queries, view_queries, source_queries, language_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
