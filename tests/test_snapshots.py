from datetime import datetime

from pyspark.sql import functions as F
from tracewake.operators.snapshots import artifact_changes, diff_snapshots

SNAPSHOT = "id long, repository_id long, branch_name string, commit_sha string, tree_sha string, committed_at timestamp, status string, failure_reason string, recorded_at timestamp"
VERSION = "id long, repository_id long, artifact_id long, snapshot_id long, content_sha256 string, git_blob_sha string"
ARTIFACT = "id long, repository_id long, path string, kind string"
A, B = "a" * 64, "b" * 64


def snapshot(i, day, status="ready", branch="main", repository=1):
    return (i, repository, branch, "c", None, datetime(2024, 1, day), status, None, None)


def test_chain_passes_over_failed_and_late_snapshots(spark, rows):
    # Recorded out of order; 3 failed; 4 holds nothing; one row twice.
    snaps = [snapshot(5, 1), snapshot(2, 2), snapshot(3, 3, "failed"), snapshot(4, 4), snapshot(1, 5), snapshot(1, 5), snapshot(9, 1, branch="other")]
    versions = [(1, 1, 10, 5, A, None), (2, 1, 10, 2, A.upper(), None), (3, 1, 11, 2, B, None), (3, 1, 11, 2, B, None), (4, 1, 11, 3, A, None), (5, 1, 11, 1, A, None), (6, 1, 99, 2, A, None)]
    arts = [(10, 1, "x.ts", "code"), (11, 1, "X.ts", None), (11, 1, "X.ts", None), (12, 1, None, None)]
    found = artifact_changes(spark.createDataFrame(snaps, SNAPSHOT), spark.createDataFrame(versions, VERSION), spark.createDataFrame(arts, ARTIFACT))
    assert rows(found.select("base_snapshot_id", "target_snapshot_id", "path", "change_kind")) == [
        (2, 4, "X.ts", "deleted"), (2, 4, "x.ts", "deleted"), (4, 1, "X.ts", "added"), (5, 2, "X.ts", "added"),
    ]


def test_empty_tables(spark):
    empty = artifact_changes(spark.createDataFrame([], SNAPSHOT), spark.createDataFrame([], VERSION), spark.createDataFrame([], ARTIFACT))
    assert empty.count() == 0


def test_diff_keeps_null_apart_and_ignores_extra_columns(spark, rows):
    base = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "c", 1), (3, "c", 1), (None, "n", 1)], "k long, v string, __side long")
    target = spark.createDataFrame([(1, "a", "z"), (2, "", "z"), (4, "d", "z"), (None, "n", "z")], "k long, v string, extra string")
    assert rows(diff_snapshots(base, target, ["k"]).select("k", "change_kind")) == [(2, "modified"), (3, "deleted"), (4, "added")]
    assert diff_snapshots(base, base, ["k"]).count() == 0
    assert diff_snapshots(base, target.limit(0), ["k"]).filter("change_kind = 'deleted'").count() == 4


def test_diff_uses_one_shuffle(spark):
    base = spark.range(10).withColumn("v", F.lit(1))
    plan = diff_snapshots(base, base, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
