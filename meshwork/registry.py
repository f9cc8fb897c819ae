"""Registered queries over the graph operators, with the SQL that states each."""

from __future__ import annotations

from meshwork.plans import generator_queries, graph_queries, planting_queries, source_queries, statistics_queries, structure_queries

_MODULES = (graph_queries, structure_queries, planting_queries, statistics_queries, generator_queries, source_queries)
QUERIES: dict = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
