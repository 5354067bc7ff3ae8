"""Queries on evaluation passages in documents (8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewake.llm.leakage import leaked
from tracewake.session import table


def _leaked(spark, root):
    return leaked(table(spark, root, "documents"), table(spark, root, "eval_item"))


def p8_found(spark, root):
    return _leaked(spark, root).select("doc_id", "item_id")


def p8_items(spark, root):
    """Of each test item that leaked, how many documents hold it and how much of it at most."""
    return _leaked(spark, root).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("most_words"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
SQL: dict[str, str] = {}
