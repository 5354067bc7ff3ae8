import os
import subprocess

import pytest
from pyspark.sql import functions as F
from tracewake.operators import report, validate
from tracewake.operators.ingest import artifact_ids, publish, record_failure, table_digest
from tracewake.sources import documents, files, git
from tracewake.streaming import index


def test_canonical_json():
    assert documents.canonical({"b": [1.0, 0.1, 1e21, 1e-7, 1e-6, -0.0], "a": "é\n"}) == '{"a":"é\\n","b":[1,0.1,1e+21,1e-7,0.000001,0]}'
    for bad in (float("nan"), 2**60, object()):
        with pytest.raises((ValueError, TypeError)):
            documents.canonical(bad)


def test_journal(tmp_path):
    path = str(tmp_path / "j")
    j = documents.Journal(path, {"run": 1}, ["a", "b", "c"])
    j.append("a", 1)
    with pytest.raises(ValueError):
        j.append("c", 1)
    with open(path, "a") as f:
        f.write('{"key":"b"')
    again = documents.Journal(path, {"run": 1}, ["a", "b", "c"])
    assert again.missing == ["b", "c"] and again.records == {"a": 1}
    again.append("b", None)
    with pytest.raises(RuntimeError):
        j.append("b", 2)
    with pytest.raises(ValueError):
        documents.Journal(path, {"run": 2}, [])


def test_release_and_lock(tmp_path):
    documents.release({"a.json": {"x": 1}}, str(tmp_path / "r"))
    assert documents.verify_release(str(tmp_path / "r")) == []
    with pytest.raises(FileExistsError):
        documents.publish({"a.json": b"other"}, str(tmp_path / "r"))
    (tmp_path / "r/a.json").write_text("{}")
    assert documents.verify_release(str(tmp_path / "r")) == ["a.json: changed"]
    with documents.lock(str(tmp_path / "l"), "me"), pytest.raises(FileExistsError), documents.lock(str(tmp_path / "l"), "you"):
        pass


def test_store(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    assert table_digest(df, ["id"]).collect() == table_digest(df.orderBy(F.desc("id")), ["id"]).collect() != table_digest(df.withColumn("v", F.lit("")), ["id"]).collect()
    publish({"t": df}, str(tmp_path / "s"), {"run": 1})
    with pytest.raises(FileExistsError):
        publish({"t": df}, str(tmp_path / "s"), {"run": 1})
    arts = "repository_id long, path string, kind string"
    known = spark.createDataFrame([(4, 1, "a", "code")], "id long, " + arts)
    assert rows(artifact_ids(spark.createDataFrame([(1, "a", "code"), (1, "c", "code"), (1, "b", None), (2, "a", "code"), (2, "a", "code")], arts), known).select("id", "repository_id", "path")) == [(1, 2, "a"), (4, 1, "a"), (5, 1, "b"), (6, 1, "c")]
    snaps = "repository_id long, commit_sha string, status string"
    after = record_failure(spark.createDataFrame([(1, "a", "ready"), (1, "b", "failed")], snaps), spark.createDataFrame([(1, "a", "failed"), (1, "b", "failed"), (1, "c", "failed")], snaps))
    assert rows(after) == [(1, "a", "ready"), (1, "b", "failed"), (1, "c", "failed")]


def test_folder(spark, tmp_path):
    (tmp_path / "dist").mkdir()
    (tmp_path / "a.ts").write_bytes(b"a\r\n")
    (tmp_path / "b.md").write_bytes(b"\x00")
    (tmp_path / "dist/c.ts").write_bytes(b"c")
    found = {r["path"]: (r["kind"], r["reason"], r["text"]) for r in files.ingest_folder(spark, str(tmp_path)).collect()}
    assert found == {"a.ts": ("code", None, "a\n"), "b.md": (None, "binary", None), "dist/c.ts": (None, "generated", None)}


@pytest.mark.skipif(not git.available(), reason="git is not installed")
def test_git(spark, rows, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True).stdout.decode().strip()
    run("init", "-q")
    (tmp_path / "a.ts").write_text("one\n" * 20)
    run("add", "-A"), run("commit", "-qm", "first #1")
    first = run("rev-parse", "HEAD")
    os.rename(tmp_path / "a.ts", tmp_path / "b.ts")
    (tmp_path / "c.ts").write_text("new")
    run("add", "-A"), run("commit", "-qm", "second")
    second = run("rev-parse", "HEAD")
    repo = str(tmp_path)
    assert rows(git.diff(spark, repo, first, second)) == [("added", "c.ts", None, None), ("renamed", "b.ts", "a.ts", 100)]
    entries = git.tree(spark, repo, second)
    assert rows(entries.select("path")) == [("b.ts",), ("c.ts",)] and git.tree(spark, repo, second, []).count() == 0
    assert {bytes(r["content"]) for r in git.blobs(entries, repo).collect()} == {b"one\n" * 20, b"new"}
    assert rows(git.history(spark, repo, second, first).select("sha")) == [(second,)]
    assert git.is_ancestor(repo, first, second) and not git.is_ancestor(repo, second, first) and not git.is_shallow(repo)
    with pytest.raises(ValueError):
        git.commit_id("HEAD")
    with pytest.raises(git.CommitNotFound):
        git.read_commit(repo, "0" * 40)


def test_validators(spark, rows):
    ranked = spark.createDataFrame([(1, 1, 5, "a"), (1, 1, 6, "b"), (2, 1, 7, "c"), (2, 2, 8, "d")], "list long, rank int, version_id long, path string")
    assert rows(validate.ranking_violations(ranked, ["list"])) == [(1, 0, 1, 0, 0)]
    assert validate.report_problems({"classification": "likely_affected", "findings": [{"statement": "x", "evidence_ids": ["e1", "e2"]}]}, {"e1"}) == ["finding 0: unknown evidence e2"]
    assert validate.leaks('{"a":{"repoPath":"x","b":["see /root/x"]}}') == ["$.a.repoPath: forbidden key", "$.a.b[0]: absolute path"]


def test_reports():
    assert report.cell(-0.00001) == "0.0000" and report.cell(None) == "–"
    assert report.pack_batches([3, 3, 5, 1], 6) == [[0, 1], [2, 3]]
    assert "## 1. `a`" in report.markdown({"description": "d", "changed": ["x"], "candidates": [{"rank": 1, "path": "a", "evidence": [{"text": "t"}]}]})


def test_evaluation_report():
    row = {"stratum": "test", "series": "hybrid", "population": 2, "mrr20_sum": 3, "mrr20_lower": 0.5, "mrr20_upper": 1.0}
    text = report.evaluation([row | {"series": "hybrid - sibling", "mrr20_sum": 0, "mrr20_lower": -0.00001}, row], [{"method": "hybrid", "status": "succeeded", "n_commits": 2}], {"outcome": "mixed", "rule": "x"}, ["mrr20"], 2)
    assert "**mixed**" in text and text.index("| hybrid | 0.7500 [0.5000, 1.0000] |") < text.index("| hybrid - sibling | 0.0000 [0.0000, 1.0000] |")


def test_frozen_copy(spark, tmp_path):
    from tracewake.operators import ingest

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    digests = ingest.freeze({"one": df, "none": df.limit(0)}, str(tmp_path / "copy"), {"by": "test"})
    assert digests["one"] == ingest.table_digest(spark.read.parquet(str(tmp_path / "copy/one")), ["id"]).first()["digest"] and set(digests) == {"one", "none"}
    with pytest.raises(FileExistsError):
        ingest.freeze({"one": df}, str(tmp_path / "copy"), {})


def test_streaming_index(spark, rows, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "sha256 string, text string"
    spark.createDataFrame([("a", "one two"), ("a", "one two"), ("b", "")], schema).coalesce(1).write.parquet(source)
    go = lambda: index.maintain(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp")).awaitTermination()
    go()
    spark.createDataFrame([("a", "one two"), ("c", "three")], schema).coalesce(1).write.mode("append").parquet(source)
    go()
    assert rows(spark.read.parquet(f"{store}/content_token").select("token", "sha256")) == [("one", "a"), ("three", "c"), ("two", "a")]
    assert rows(spark.read.parquet(f"{store}/indexed").select("sha256")) == [("a",), ("b",), ("c",)]
