"""Queries on source files: not valid (3), not written by hand (5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewake.llm.handwritten import held_out_report, not_handwritten
from tracewake.llm.syntax import invalid_rates, invalid_versions
from tracewake.session import table


def _sources(spark, root):
    return (table(spark, root, t) for t in ("artifact_version", "artifact", "content"))


def p3_found(spark, root):
    return invalid_versions(*_sources(spark, root))


def p3_rates(spark, root):
    return invalid_rates(*_sources(spark, root))


def _not_handwritten(spark, root):
    return not_handwritten(*(table(spark, root, t) for t in ("artifact_version", "artifact", "content", "repository")))


def p5_found(spark, root):
    return _not_handwritten(spark, root).select("version_id")


def p5_reasons(spark, root):
    return _not_handwritten(spark, root).groupBy("reason").agg(F.count("*").alias("n_versions"))


def p5_validation(spark, root):
    """What the classifiers do on repositories that were held out."""
    return held_out_report(*(table(spark, root, t) for t in ("artifact_version", "artifact", "content", "repository")))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates, "p5_found": p5_found, "p5_reasons": p5_reasons, "p5_validation": p5_validation}
SQL: dict[str, str] = {}
