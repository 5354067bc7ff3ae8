"""Differences between full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE, TARGET = 0, 1


def row_hash(columns: Sequence[str | Column]) -> Column:
    """SHA-256 of the columns' JSON; a null is kept apart from an empty string and from a missing row."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def classify_sides(tagged: DataFrame, keys: Sequence[str], side: str, digest: str) -> DataFrame:
    """One row per key that differs between the two sides of ``tagged``.

    ``tagged`` holds the rows of both snapshots with ``side`` (0 base, 1 target) and a digest of
    the compared columns. A single aggregation shuffle on ``keys`` decides each key; repeated rows
    collapse in its map-side part. Rows of one key and side that disagree count by their greatest digest.
    Adds ``base_digest``, ``target_digest`` and ``change_kind`` (added, deleted, modified).
    """
    present = F.coalesce(F.col(digest), F.lit(b""))
    sides = tagged.groupBy(*keys).agg(
        F.max(F.when(F.col(side) == BASE, present)).alias("base_digest"),
        F.max(F.when(F.col(side) == TARGET, present)).alias("target_digest"),
    )
    kind = (
        F.when(F.col("base_digest").isNull(), "added")
        .when(F.col("target_digest").isNull(), "deleted")
        .when(F.col("base_digest") != F.col("target_digest"), "modified")
    )
    return sides.withColumn("change_kind", kind).filter(F.col("change_kind").isNotNull())


def diff_snapshots(base: DataFrame, target: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None) -> DataFrame:
    """Keys added, deleted or modified from ``base`` to ``target``, two full snapshots of one table.

    ``compare`` defaults to all shared columns but the keys. Null keys are keys like any other;
    an empty side makes every row of the other one added or deleted; columns that only one side has are not compared.
    """
    columns = list(compare) if compare is not None else [c for c in base.columns if c in target.columns and c not in keys]
    digest = row_hash(columns) if columns else F.lit(b"")
    parts = [df.select(*keys, F.lit(tag).alias("__side"), digest.alias("__digest")) for df, tag in ((base, BASE), (target, TARGET))]
    changes = classify_sides(parts[0].unionByName(parts[1]), keys, "__side", "__digest")
    return changes.select(*keys, "change_kind", F.lower(F.hex("base_digest")).alias("base_digest"), F.lower(F.hex("target_digest")).alias("target_digest"))


def snapshot_chain(snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, base_snapshot_id, next_snapshot_id`` of every ready snapshot.

    Order is committed_at, then id, within (repository_id, branch_name); failed snapshots and those
    without committed_at are passed over, repeated rows count once.
    """
    ready = snapshots.filter((F.col("status") == "ready") & F.col("committed_at").isNotNull() & F.col("id").isNotNull()).select(
        "id", "repository_id", "branch_name", "committed_at"
    )
    order = Window.partitionBy("repository_id", "branch_name").orderBy("committed_at", "id")
    return ready.dropDuplicates(["id"]).select(
        F.col("id").alias("snapshot_id"), F.lag("id").over(order).alias("base_snapshot_id"), F.lead("id").over(order).alias("next_snapshot_id")
    )


def artifact_changes(snapshots: DataFrame, versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every artifact path that appeared, vanished or changed between consecutive ready snapshots.

    Returns ``base_snapshot_id, target_snapshot_id, path, change_kind, base_content_sha256,
    target_content_sha256``. Each version row is read once and tagged as the target of its own
    snapshot's step and as the base of the next one, then one aggregation on (step, artifact)
    classifies. Letter case of digests does not count. A snapshot without rows deletes all
    of its base and adds all of the next. A version whose artifact row is missing or has a null
    path has no path to report and gives no row. Path text is joined to changed rows only.
    """
    chain = snapshot_chain(snapshots)
    sha = F.lower(F.trim("content_sha256"))
    digest = F.when(sha.rlike("^[0-9a-f]{64}$"), F.unhex(sha)).otherwise(F.encode(sha, "UTF-8"))
    tagged = (
        versions.select("snapshot_id", "artifact_id", digest.alias("digest"))
        .join(chain, "snapshot_id")
        .select(
            "artifact_id",
            "digest",
            F.inline(
                F.array(
                    F.struct(F.col("base_snapshot_id").alias("base"), F.col("snapshot_id").alias("target"), F.lit(TARGET).alias("side")),
                    F.struct(F.col("snapshot_id").alias("base"), F.col("next_snapshot_id").alias("target"), F.lit(BASE).alias("side")),
                )
            ),
        )
        .filter(F.col("base").isNotNull() & F.col("target").isNotNull())
    )
    changes = classify_sides(tagged, ["base", "target", "artifact_id"], "side", "digest")
    paths = artifacts.filter(F.col("path").isNotNull()).groupBy(F.col("id").alias("artifact_id")).agg(F.min("path").alias("path"))
    text = lambda c: F.when(F.length(c) == 32, F.lower(F.hex(c))).otherwise(F.decode(c, "UTF-8"))
    return changes.join(paths, "artifact_id").select(
        F.col("base").alias("base_snapshot_id"),
        F.col("target").alias("target_snapshot_id"),
        "path",
        "change_kind",
        text(F.col("base_digest")).alias("base_content_sha256"),
        text(F.col("target_digest")).alias("target_content_sha256"),
    )
