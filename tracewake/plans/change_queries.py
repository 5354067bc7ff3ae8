"""Queries on what changed between snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewake.operators.snapshots import artifact_changes
from tracewake.session import table


def _changes(spark, root):
    return artifact_changes(*(table(spark, root, t) for t in ("repository_snapshot", "artifact_version", "artifact")))


def p1_found(spark, root):
    return _changes(spark, root).select("base_snapshot_id", "target_snapshot_id", "path", "change_kind")


def p1_change_rates(spark, root):
    return _changes(spark, root).groupBy("change_kind").agg(F.count("*").alias("n_changes"), F.countDistinct("target_snapshot_id").alias("n_snapshots"))


_SQL = """
WITH chain AS (
  SELECT id AS target, lag(id) OVER w AS base FROM (
    SELECT DISTINCT id, repository_id, branch_name, committed_at FROM repository_snapshot WHERE status = 'ready')
  WINDOW w AS (PARTITION BY repository_id, branch_name ORDER BY committed_at, id)),
v AS (SELECT DISTINCT snapshot_id, artifact_id, lower(content_sha256) AS sha FROM artifact_version),
b AS (SELECT c.base, c.target, v.artifact_id, v.sha FROM chain c JOIN v ON v.snapshot_id = c.base),
t AS (SELECT c.base, c.target, v.artifact_id, v.sha FROM chain c JOIN v ON v.snapshot_id = c.target WHERE c.base IS NOT NULL),
d AS (
  SELECT coalesce(b.base, t.base) AS base_snapshot_id, coalesce(b.target, t.target) AS target_snapshot_id,
         coalesce(b.artifact_id, t.artifact_id) AS artifact_id,
         CASE WHEN b.sha IS NULL THEN 'added' WHEN t.sha IS NULL THEN 'deleted' WHEN b.sha <> t.sha THEN 'modified' END AS change_kind
  FROM b FULL OUTER JOIN t ON b.base = t.base AND b.target = t.target AND b.artifact_id = t.artifact_id),
found AS (
  SELECT d.base_snapshot_id, d.target_snapshot_id, a.path, d.change_kind
  FROM d JOIN (SELECT DISTINCT id, path FROM artifact) a ON a.id = d.artifact_id WHERE d.change_kind IS NOT NULL)
"""

QUERIES = {"p1_found": p1_found, "p1_change_rates": p1_change_rates}
SQL = {
    "p1_found": _SQL + "SELECT * FROM found",
    "p1_change_rates": _SQL + "SELECT change_kind, count(*) AS n_changes, count(DISTINCT target_snapshot_id) AS n_snapshots FROM found GROUP BY 1",
}
