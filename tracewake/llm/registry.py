"""Collects the query modules of this folder."""

from __future__ import annotations

from tracewake.llm import consensus_queries, leak_queries, source_queries, subject_queries, text_queries, vector_queries

MODULES = (text_queries, vector_queries, leak_queries, subject_queries, consensus_queries, source_queries)


def llm_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def llm_sql() -> dict:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
