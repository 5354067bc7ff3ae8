"""Repositories as DataFrames, read with the git command where it is installed."""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

COMMIT = re.compile(r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$")
TREE = "mode string, type string, object_sha string, size long, path string"
CHANGES = "status string, path string, previous_path string, similarity int"
_STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "T": "type_changed"}


class CommitNotFound(LookupError):
    pass


def available() -> bool:
    return shutil.which("git") is not None


def _git(repo: str, *args: str, check: bool = True) -> bytes:
    found = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    if check and found.returncode:
        raise RuntimeError(f"git {args[0]} failed: {found.stderr.decode(errors='replace').strip()}")
    return found.stdout if not found.returncode else b""


def commit_id(text: str) -> str:
    """A full commit id in lower case; names of branches and short ids are an error."""
    if not COMMIT.match(text.lower()):
        raise ValueError(f"not a full commit id: {text!r}")
    return text.lower()


def verify_repository(repo: str) -> None:
    if _git(repo, "rev-parse", "--is-inside-work-tree", "--is-bare-repository", check=False) == b"":
        raise ValueError(f"no repository at {repo}")


def is_shallow(repo: str) -> bool:
    return _git(repo, "rev-parse", "--is-shallow-repository").strip() == b"true"


def read_commit(repo: str, sha: str) -> dict:
    sha = commit_id(sha)
    kind = _git(repo, "cat-file", "-t", sha, check=False).strip()
    if kind != b"commit":
        raise CommitNotFound(sha)
    tree, seconds = _git(repo, "show", "-s", "--format=%T %ct", sha).decode().split()
    return {"sha": sha, "tree_sha": tree, "committed_at_seconds": int(seconds)}


def is_ancestor(repo: str, ancestor: str, of: str) -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", commit_id(ancestor), commit_id(of)], capture_output=True).returncode == 0


def tree(spark: SparkSession, repo: str, sha: str, paths: list[str] | None = None) -> DataFrame:
    """Entries of a commit's tree; an empty list of paths gives none."""
    rows = []
    if paths is None or paths:
        spec = ["--", *[f":(literal){p}" for p in paths]] if paths else []
        for record in filter(None, _git(repo, "ls-tree", "-r", "-l", "-z", commit_id(sha), *spec).split(b"\0")):
            head, path = record.split(b"\t", 1)
            mode, kind, blob, size = head.decode().split()
            rows.append((mode, kind, blob, None if size == "-" else int(size), path.decode("utf-8", "replace")))
    return spark.createDataFrame(rows, TREE)


def blobs(entries: DataFrame, repo: str) -> DataFrame:
    """``object_sha, content`` of the distinct blobs of ``entries``, each task with one long-lived reader; the repository must be reachable from executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for frame in frames:
                out = []
                for sha in frame["object_sha"]:
                    reader.stdin.write(sha.encode() + b"\n")
                    reader.stdin.flush()
                    head = reader.stdout.readline().split()
                    if head[-1:] == [b"missing"]:
                        raise LookupError(f"no object {sha}")
                    out.append(reader.stdout.read(int(head[2])))
                    reader.stdout.read(1)
                yield pd.DataFrame({"object_sha": frame["object_sha"], "content": out})
        finally:
            reader.stdin.close()
            reader.wait()

    return entries.filter("type = 'blob'").select("object_sha").distinct().mapInPandas(run, "object_sha string, content binary")


def history(spark: SparkSession, repo: str, head: str, since: str | None = None) -> DataFrame:
    """Commits reachable from ``head`` and not from ``since``."""
    ends = [commit_id(head), *([f"^{commit_id(since)}"] if since else [])]
    rows = []
    for record in filter(None, _git(repo, "log", "-z", "--format=%H%x01%P%x01%ct%x01%s", *ends).decode("utf-8", "replace").split("\0")):
        sha, parents, seconds, subject = record.split("\x01", 3)
        rows.append((sha, parents.split(), int(seconds), subject))
    return spark.createDataFrame(rows, "sha string, parents array<string>, committed_at_seconds long, subject string")


def diff(spark: SparkSession, repo: str, base: str, target: str) -> DataFrame:
    """Changed files from ``base`` to ``target``; renames from half similarity on, no copies."""
    fields = _git(repo, "diff-tree", "-r", "-z", "--no-commit-id", "--name-status", "-M50%", commit_id(base), commit_id(target)).decode("utf-8", "replace").split("\0")
    rows, i = [], 0
    while i < len(fields) - 1:
        code = fields[i]
        if code[0] == "R":
            rows.append((_STATUS["R"], fields[i + 2], fields[i + 1], int(code[1:])))
            i += 3
        else:
            rows.append((_STATUS[code[0]], fields[i + 1], None, None))
            i += 2
    return spark.createDataFrame(rows, CHANGES)
