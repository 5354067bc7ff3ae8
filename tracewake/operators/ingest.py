"""File trees into content-addressed tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewake.functions import paths


def classify_tree(entries: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``reason`` (why left out, else null) to ``mode, path, size``."""
    reason = paths.exclusion(F.col("mode"), F.col("path"), F.col("size"))
    return entries.withColumn("reason", reason).withColumn("kind", F.when(reason.isNull(), paths.kind(F.col("path"))))


def normalise_content(data: Column) -> Column:
    """``text, sha256, byte_length, reason`` of raw bytes: no NUL, strict UTF-8, no BOM, LF line ends."""
    text = F.regexp_replace(F.regexp_replace(data.cast("string"), "^﻿", ""), "\r\n?", "\n")
    reason = F.when(F.contains(data, F.lit(b"\x00")), "binary").when(~F.is_valid_utf8(data.cast("string")), "not_utf8")
    kept = F.when(reason.isNull(), text)
    return F.struct(kept.alias("text"), F.sha2(kept, 256).alias("sha256"), F.octet_length(kept).cast("long").alias("byte_length"), reason.alias("reason"))


def new_contents(found: DataFrame, known: DataFrame) -> DataFrame:
    """Contents of ``found`` whose sha256 is not in ``known``, once each: the insert-if-absent of a content-addressed store."""
    return found.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")


def artifact_ids(found: DataFrame, known: DataFrame) -> DataFrame:
    """Known artifacts and new ones of ``repository_id, path, kind``; new ids follow the greatest of the repository, in path order.

    Ids are numbered within a repository, so that no global sort is needed: an id is unique together with its repository_id.
    """
    new = found.select("repository_id", "path", "kind").dropDuplicates(["repository_id", "path"]).join(known, ["repository_id", "path"], "left_anti")
    top = known.groupBy("repository_id").agg(F.max("id").alias("top"))
    order = Window.partitionBy("repository_id").orderBy("path")
    added = new.join(top, "repository_id", "left").select((F.coalesce("top", F.lit(0)) + F.row_number().over(order)).cast("long").alias("id"), "repository_id", "path", "kind")
    return known.select("id", "repository_id", "path", "kind").unionByName(added)


def publish(tables: dict[str, DataFrame], folder: str, manifest: dict) -> str:
    """Writes tables to ``folder/staging`` and makes them visible by writing the manifest last.

    A folder with a manifest is complete and never overwritten; readers go by the manifest. On Hadoop file systems the same
    order holds, since the manifest is one small file.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder, "_manifest.json")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        raise FileExistsError(f"{folder} is already published")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    out = fs.create(path, False)
    out.write(bytearray(json.dumps(manifest | {"tables": sorted(tables)}, sort_keys=True).encode()))
    out.close()
    return os.path.join(folder, "_manifest.json")


def record_failure(snapshots: DataFrame, failed: DataFrame) -> DataFrame:
    """Snapshots with ``failed`` ones added or renewed; a ready snapshot of the same repository and commit is never replaced."""
    ready = snapshots.filter("status = 'ready'")
    kept = snapshots.filter("status <> 'ready'").join(failed, ["repository_id", "commit_sha"], "left_anti")
    fresh = failed.join(ready, ["repository_id", "commit_sha"], "left_anti")
    return ready.unionByName(kept).unionByName(fresh, allowMissingColumns=True)


def snapshot_artifacts(versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each version with its artifact's path and kind, once."""
    named = artifacts.groupBy(F.col("id").alias("artifact_id")).agg(F.min("path").alias("path"), F.min("kind").alias("kind"))
    rows = versions.dropDuplicates(["id"]).select(F.col("id").alias("version_id"), "repository_id", "artifact_id", "snapshot_id", F.lower("content_sha256").alias("sha256"))
    return rows.join(named, "artifact_id")


def find_artifact(rows: DataFrame, snapshot_id: int, path: str) -> DataFrame:
    return rows.filter((F.col("snapshot_id") == snapshot_id) & (F.col("path") == path))


def require_ready(snapshots: DataFrame, snapshot_id: int):
    """The snapshot's row; an error if it is unknown or not ready."""
    row = snapshots.filter(F.col("id") == snapshot_id).first()
    if row is None:
        raise LookupError(f"no snapshot {snapshot_id}")
    if row["status"] != "ready":
        raise ValueError(f"snapshot {snapshot_id} is {row['status']}")
    return row


def table_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """``n_rows, digest``: a digest that does not depend on row order, from two sums over row hashes.

    Sums combine before the shuffle and need no sorted list of all rows in one place.
    """
    row = F.to_json(F.struct(*keys, *[c for c in df.columns if c not in keys]), {"ignoreNullFields": "false"})
    part = lambda i: F.conv(F.substring(F.sha2(row, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(4)]).select(
        "n_rows", F.sha2(F.concat_ws(":", "n_rows", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest")
    )


def freeze(tables: dict[str, DataFrame], folder: str, manifest: dict) -> dict[str, str]:
    """Writes tables once, as :func:`publish` does, and gives the digest of each, which must be the same before and after.

    A table that changed while it was copied is an error; readers of the copy can check it against the digests.
    """
    spark = next(iter(tables.values())).sparkSession
    take = lambda df: tuple(table_digest(df, sorted(df.columns)[:1]).first())
    before = {name: take(df) for name, df in tables.items()}
    publish(tables, folder, manifest | {"digests": {name: d[1] for name, d in before.items()}})
    for name, known in before.items():
        if take(spark.read.parquet(f"{folder}/{name}").select(*tables[name].columns)) != known:
            raise ValueError(f"{name} is not what it was before it was copied")
    return {name: d[1] for name, d in before.items()}
