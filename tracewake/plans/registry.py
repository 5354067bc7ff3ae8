"""Collects the query modules of the core."""

from __future__ import annotations

from tracewake.plans import assembly_queries, change_queries, detail_queries, evaluation_queries, retrieval_queries, snapshot_queries

MODULES = (change_queries, retrieval_queries, evaluation_queries, detail_queries, assembly_queries, snapshot_queries)


def core_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def core_sql() -> dict:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
