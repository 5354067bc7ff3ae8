"""Queries on the subjects of documents (9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewake.llm.subjects import assign_subjects, function_accuracies
from tracewake.session import table


def _assigned(spark, root):
    return assign_subjects(*(table(spark, root, t) for t in ("documents", "subject_label", "subject_area")))


def p9_found(spark, root):
    return _assigned(spark, root).select("doc_id", "subject")


def p9_composition(spark, root):
    """Documents and their share of all documents by subject."""
    total = table(spark, root, "documents").agg(F.count("*").alias("all"))
    return _assigned(spark, root).groupBy("subject").agg(F.count("*").alias("n_documents")).join(F.broadcast(total)).select("subject", "n_documents", (F.col("n_documents") / F.col("all")).alias("share"))


def p9_functions(spark, root):
    """Coverage and learned accuracy of each labelling function."""
    return function_accuracies(*(table(spark, root, t) for t in ("documents", "subject_label", "subject_area")))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition, "p9_functions": p9_functions}
SQL: dict[str, str] = {}
