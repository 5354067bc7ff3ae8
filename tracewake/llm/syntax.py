"""Flags source files that are not valid in the language their path names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.llm.ecma import JS, JSX, TS, TSX, dialects, is_json

JSON = 16
#: The dialect of each extension, and the language it is reported as.
EXTENSIONS = {"ts": (TS, "typescript"), "mts": (TS, "typescript"), "tsx": (TSX, "typescript-jsx"), "js": (JS, "javascript"), "mjs": (JS, "javascript"), "cjs": (JS, "javascript"), "jsx": (JSX, "javascript-jsx"), "json": (JSON, "json")}


def digest(name: str) -> Column:
    sha = F.lower(F.trim(name))
    return F.when(sha.rlike("^[0-9a-f]{64}$"), F.unhex(sha)).otherwise(F.encode(sha, "UTF-8"))


def _by_extension(path: Column, at: int) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.create_map(*[F.lit(x) for e, v in EXTENSIONS.items() for x in (e, v[at])])[extension]


def accepted_dialects(contents: DataFrame) -> DataFrame:
    """``sha, accepted``: the dialects in which each content is valid, as a sum of JS 1, JSX 2, TS 4, TSX 8 and JSON 16.

    Texts are recognised where they are read and never move; what moves is a digest and a number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dialects(t) | (JSON if is_json(t) else 0) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["sha", "accepted"])

    return contents.select(digest("sha256").alias("sha"), "text").filter(F.col("text").isNotNull()).mapInArrow(run, "sha binary, accepted int")


def checked_versions(versions: DataFrame, artifacts: DataFrame, contents: DataFrame) -> DataFrame:
    """``version_id, repository_id, language, valid`` of every version whose path names a language.

    The dialect grammars run together over one graph-structured stack, so a content costs one pass whatever paths it has.
    Empty code is valid, empty JSON is not. Versions whose artifact row, path or text is missing are left out, repeated rows
    count once, and contents given twice must agree or the row with the more dialects counts.
    """
    path = F.col("path")
    named = artifacts.select(F.col("id").alias("artifact_id"), _by_extension(path, 0).alias("dialect"), _by_extension(path, 1).alias("language")).filter("dialect IS NOT NULL").dropDuplicates(["artifact_id"])
    kept = versions.select(F.col("id").alias("version_id"), "repository_id", "artifact_id", digest("content_sha256").alias("sha")).filter("version_id IS NOT NULL").join(named, "artifact_id")
    accepted = accepted_dialects(contents).groupBy("sha").agg(F.max("accepted").alias("accepted"))
    return kept.join(accepted, "sha").select("version_id", "repository_id", "language", (F.col("accepted").bitwiseAND(F.col("dialect")) != 0).alias("valid"))


def invalid_versions(versions: DataFrame, artifacts: DataFrame, contents: DataFrame) -> DataFrame:
    """``version_id`` of each version that is not valid in its language."""
    return checked_versions(versions, artifacts, contents).filter(~F.col("valid")).select("version_id").distinct()


def invalid_rates(versions: DataFrame, artifacts: DataFrame, contents: DataFrame) -> DataFrame:
    """Versions, invalid ones and their share by repository and language."""
    rows = checked_versions(versions.dropDuplicates(["id"]), artifacts, contents)
    counted = rows.groupBy("repository_id", "language").agg(F.count("*").alias("n_versions"), F.count_if(~F.col("valid")).alias("n_invalid"))
    return counted.withColumn("invalid_rate", F.col("n_invalid") / F.col("n_versions"))
