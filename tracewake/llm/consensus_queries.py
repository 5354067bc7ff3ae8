"""Queries on annotators' labels (6)."""

from __future__ import annotations

from tracewake.llm.consensus import consensus
from tracewake.session import table


def p6_found(spark, root):
    return consensus(table(spark, root, "annotation_record"))[0].select("case_id", "candidate_version_id", "classification")


def p6_consensus(spark, root):
    return consensus(table(spark, root, "annotation_record"))[0]


def p6_annotators(spark, root):
    return consensus(table(spark, root, "annotation_record"))[1]


QUERIES = {"p6_found": p6_found, "p6_consensus": p6_consensus, "p6_annotators": p6_annotators}
SQL: dict[str, str] = {}
