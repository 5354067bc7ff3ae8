"""Projects, repositories and snapshots of a store, and the way of a commit's files into it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewake.operators import ingest


def _next(rows: DataFrame) -> int:
    return (rows.agg(F.max("id")).first()[0] or 0) + 1


def create_project(projects: DataFrame, name: str) -> DataFrame:
    """``projects`` (``id, name``) and one more, its name without blanks around it."""
    return projects.unionByName(projects.sparkSession.createDataFrame([(_next(projects), name.strip())], projects.select("id", "name").schema))


def register_repository(repositories: DataFrame, projects: DataFrame, project_id: int, name: str, path: str) -> DataFrame:
    """``repositories`` (``id, project_id, repo_name, source_path``) and one more of a known project, with an absolute path."""
    if projects.filter(F.col("id") == project_id).isEmpty():
        raise LookupError(f"no project {project_id}")
    row = (_next(repositories), project_id, name.strip(), os.path.abspath(path))
    return repositories.unionByName(repositories.sparkSession.createDataFrame([row], repositories.select("id", "project_id", "repo_name", "source_path").schema))


def by_id(rows: DataFrame, id_: int):
    """The row of a project, repository or snapshot, or none."""
    return rows.filter(F.col("id") == id_).first()


def find_snapshot(snapshots: DataFrame, repository_id: int, commit: str):
    """The snapshot of a commit, a ready one first, or none."""
    found = snapshots.filter((F.col("repository_id") == repository_id) & (F.lower("commit_sha") == commit.lower()))
    return found.orderBy((F.col("status") == "ready").desc(), "id").first()


def excluded_entries(excluded: DataFrame, snapshot_id: int) -> DataFrame:
    """``path, reason`` of what was kept out of a snapshot, by path."""
    return excluded.filter(F.col("snapshot_id") == snapshot_id).select("path", "reason").distinct().orderBy("path")


def content_of(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sha256, text`` of the wanted digests, whatever the case of their letters."""
    keys = wanted.select(F.lower("sha256").alias("sha256")).distinct()
    return contents.select(F.lower("sha256").alias("sha256"), "text").join(keys, "sha256", "left_semi").dropDuplicates(["sha256"])


def ingest_snapshot(store: dict[str, DataFrame], repository_id: int, commit: dict, collected: DataFrame, branch: str = "main") -> tuple[dict[str, DataFrame], int, bool]:
    """The store with a commit's snapshot, its id, and whether it is new.

    ``commit`` has ``sha, tree_sha, committed_at`` (a datetime); ``collected`` has ``path, kind, sha256, text, byte_length, git_blob_sha, reason``, the reason of what is left
    out, else null. A commit that is ready already is left as it is; a failed snapshot of it is replaced. Contents and artifacts that the store has are used again.
    Nothing is written: publish the frames with :func:`tracewake.operators.ingest.publish`, which makes them visible at once.
    """
    if by_id(store["repository"], repository_id) is None:
        raise LookupError(f"no repository {repository_id}")
    snapshots = store["repository_snapshot"]
    known = find_snapshot(snapshots, repository_id, commit["sha"])
    if known is not None and known["status"] == "ready":
        return store, known["id"], False
    spark = collected.sparkSession
    number = _next(snapshots)
    row = spark.createDataFrame([(number, repository_id, branch, commit["sha"], commit.get("tree_sha"), commit.get("committed_at"), "ready", None)], "id long, repository_id long, branch_name string, commit_sha string, tree_sha string, committed_at timestamp, status string, failure_reason string")
    row = row.withColumn("committed_at", F.col("committed_at").cast(snapshots.schema["committed_at"].dataType)).withColumn("recorded_at", F.current_timestamp().cast(snapshots.schema["recorded_at"].dataType))
    same = (F.col("repository_id") == repository_id) & (F.lower("commit_sha") == commit["sha"].lower())
    kept = collected.filter("reason IS NULL")
    artifacts = ingest.artifact_ids(kept.select(F.lit(repository_id).cast("long").alias("repository_id"), "path", "kind"), store["artifact"].dropDuplicates(["id"]))
    own = artifacts.filter(F.col("repository_id") == repository_id).select(F.col("id").alias("artifact_id"), "path")
    versions = store["artifact_version"]
    first = _next(versions)
    # The files of one commit: one snapshot's share, not the table.
    added = kept.join(own, "path").select((F.row_number().over(Window.orderBy("path")) - 1 + first).cast("long").alias("id"), F.lit(repository_id).cast("long").alias("repository_id"), "artifact_id", F.lit(number).cast("long").alias("snapshot_id"), F.col("sha256").alias("content_sha256"), "git_blob_sha")
    contents = ingest.new_contents(kept.select("sha256", "text", "byte_length"), store["content"].select(F.lower("sha256").alias("sha256")))
    left_out = collected.filter("reason IS NOT NULL").select(F.lit(number).cast("long").alias("snapshot_id"), "path", "reason")
    return store | {
        "repository_snapshot": snapshots.filter(~(same & (F.col("status") != "ready"))).unionByName(row), "artifact": artifacts, "artifact_version": versions.unionByName(added), "content": store["content"].unionByName(contents),
        "excluded_entry": store["excluded_entry"].unionByName(left_out),
    }, number, True


def ingestion_failure(store: dict[str, DataFrame], repository_id: int, commit: dict, reason: str, branch: str = "main") -> dict[str, DataFrame]:
    """The store with a failed snapshot of a commit that could not be taken in, unless a ready one is there."""
    snapshots = store["repository_snapshot"]
    row = (_next(snapshots), repository_id, branch, commit["sha"], commit.get("tree_sha"), None, "failed", reason, None)
    failed = snapshots.sparkSession.createDataFrame([row], snapshots.schema)
    return store | {"repository_snapshot": ingest.record_failure(snapshots, failed)}
