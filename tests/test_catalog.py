from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tracewake.functions import dates
from tracewake.operators import catalog, semantic

SCHEMAS = {
    "repository": "id long, project_id long, repo_name string, source_path string",
    "repository_snapshot": "id long, repository_id long, branch_name string, commit_sha string, tree_sha string, committed_at timestamp, status string, failure_reason string, recorded_at timestamp",
    "artifact": "id long, repository_id long, path string, kind string", "artifact_version": "id long, repository_id long, artifact_id long, snapshot_id long, content_sha256 string, git_blob_sha string",
    "content": "sha256 string, text string, byte_length long", "excluded_entry": "snapshot_id long, path string, reason string",
}


def test_projects_and_snapshots(spark, rows):
    projects = catalog.create_project(spark.createDataFrame([], "id long, name string"), " First ")
    assert rows(projects) == [(1, "First")]
    store = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    store["repository"] = catalog.register_repository(store["repository"], projects, 1, " one ", "/srv/one")
    assert rows(store["repository"]) == [(1, 1, "one", "/srv/one")]
    with pytest.raises(LookupError):
        catalog.register_repository(store["repository"], projects, 2, "x", "/x")
    commit = {"sha": "a" * 40, "committed_at": datetime(2024, 1, 1)}
    store = catalog.ingestion_failure(store, 1, commit, "unreadable")
    assert catalog.find_snapshot(store["repository_snapshot"], 1, "A" * 40)["failure_reason"] == "unreadable"
    files = spark.createDataFrame([("b.ts", "code", "s1", "x", 1, "g1", None), ("a.md", "document", "s2", "y", 1, "g2", None), ("c.bin", None, None, None, None, None, "binary")], "path string, kind string, sha256 string, text string, byte_length long, git_blob_sha string, reason string")
    store, number, new = catalog.ingest_snapshot(store, 1, commit, files)
    assert new and rows(store["repository_snapshot"].select("id", "status")) == [(number, "ready")]
    assert rows(store["artifact"].select("id", "path")) == [(1, "a.md"), (2, "b.ts")] and rows(store["artifact_version"].select("id", "artifact_id", "content_sha256")) == [(1, 1, "s2"), (2, 2, "s1")]
    assert rows(catalog.excluded_entries(store["excluded_entry"], number)) == [("c.bin", "binary")] and store["content"].count() == 2
    again = catalog.ingest_snapshot(store, 1, commit, files)
    assert again[1:] == (number, False)
    later, second, _ = catalog.ingest_snapshot(store, 1, {"sha": "b" * 40}, files.filter("path <> 'c.bin'").withColumn("sha256", F.when(F.col("path") == "b.ts", "s3").otherwise(F.col("sha256"))))
    assert second == number + 1 and later["artifact"].count() == 2 and rows(later["content"].select("sha256")) == [("s1",), ("s2",), ("s3",)] and later["artifact_version"].count() == 4
    assert rows(catalog.ingestion_failure(later, 1, commit, "late")["repository_snapshot"].select("status")) == [("ready",), ("ready",)]
    assert rows(catalog.content_of(store["content"], spark.createDataFrame([("S1",), ("none",)], "sha256 string"))) == [("s1", "x")]
    with pytest.raises(LookupError):
        catalog.ingest_snapshot(store, 9, commit, files)


def test_times(spark):
    good = {"2024-03-01T01:30:00+02:00": "2024-02-29T23:30:00.000Z", "2024-03-01T01:30:00.1239Z": "2024-03-01T01:30:00.123Z", None: None}
    df = spark.createDataFrame([(k,) for k in good], "t string").select("t", dates.normalise_timestamp(F.col("t")).alias("u"))
    assert {r["t"]: r["u"] for r in df.collect()} == good
    for bad in ("2024-03-01T01:30:00", "2024-13-01T01:30:00Z", "yesterday", ""):
        with pytest.raises(Exception, match="not a time"):
            spark.createDataFrame([(bad,)], "t string").select(dates.normalise_timestamp(F.col("t"))).collect()


def test_older_inputs(spark, rows):
    assert semantic.older_inputs("a.md", "x" * 28_000) == ["search_document: File: a.md\n\n" + "x" * 28_000]
    text = "# a\n" + "x" * 20_000 + "\n# b\n" + "y" * 20_000 + "\n# c\n" + ("z" * 9_999 + "\n") * 4 + "w" * 30_000
    bodies = [i.split("\n\n", 1)[1] for i in semantic.older_inputs("a.md", text)]
    assert [len(b) for b in bodies][:2] == [20_005, 20_005] and "".join(bodies) == text + "\n" and max(map(len, bodies)) == 30_001
    hits = semantic.first_hits(spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.9), (1, "b", 0.7), (1, "c", 0.7)], "q int, path string, similarity double"), ["q"])
    assert rows(hits) == [(1, "a", 0.9, 1), (1, "b", 0.7, 2), (1, "c", 0.7, 3)]
