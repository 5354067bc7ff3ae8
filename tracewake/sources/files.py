"""Folders, parquet stores and labelled cases as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewake.operators.ingest import classify_tree, normalise_content

STORE = ("repository", "repository_snapshot", "artifact", "artifact_version", "content", "excluded_entry", "semantic_embedding", "semantic_chunk")


def folder(spark: SparkSession, root: str) -> DataFrame:
    """``path, mode, size, content`` of every file under a folder; content is read only if a query needs it."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:(//)?", ""), f"^{base}", "")
    return files.select(F.decode(F.encode(relative, "UTF-8"), "UTF-8").alias("path"), F.lit("100644").alias("mode"), F.col("length").alias("size"), "content")


def ingest_folder(spark: SparkSession, root: str) -> DataFrame:
    """Files of a folder with ``kind``, normalised ``text, sha256, byte_length`` and the ``reason`` of what is left out."""
    rows = classify_tree(folder(spark, root))
    data = F.when(F.col("reason").isNull(), F.col("content"))
    read = rows.withColumn("__c", normalise_content(data))
    return read.select("path", "mode", "size", F.coalesce("reason", "__c.reason").alias("reason"), F.when(F.coalesce("reason", "__c.reason").isNull(), F.col("kind")).alias("kind"), "__c.text", "__c.sha256", "__c.byte_length")


def store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a store that exist under ``root``."""
    found = {}
    for name in STORE:
        path = f"{root}/{name}.parquet"
        if "://" in path or os.path.exists(path):
            found[name] = spark.read.parquet(path)
    return found


def labelled_cases(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Labelled cases given as parsed documents: ``case_id, repository, base_commit, description, changed, candidates``."""
    out = []
    for r in rows:
        changed = [(c["path"], c.get("symbols") or []) for c in r.get("changed_artifacts") or []]
        candidates = [(c["path"], c.get("relationship"), c.get("relevance")) for c in r.get("candidates") or []]
        out.append((r["case_id"], r["repository"]["name"], r["repository"]["base_commit"], r.get("description"), changed, candidates))
    return spark.createDataFrame(
        out, "case_id string, repository string, base_commit string, description string, changed array<struct<path:string,symbols:array<string>>>, candidates array<struct<path:string,relationship:string,relevance:string>>"
    )
