"""All registered queries of the analysis engine and their SQL."""

from __future__ import annotations

from factloom.plans import assignment_queries, flow_queries, front_queries, graph_queries, library_queries, memory_queries, value_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for part in (flow_queries, graph_queries, front_queries, library_queries, memory_queries, value_queries, assignment_queries):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
