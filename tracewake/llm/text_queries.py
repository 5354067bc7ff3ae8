"""Queries on whole texts: chunks (2) and token ids (7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewake.llm.chunking import chunk_rows
from tracewake.llm.tokenize import encode_corpus
from tracewake.session import table


def p2_found(spark, root):
    chunks = chunk_rows(table(spark, root, "planned_artifact"))
    return chunks.filter("chunk_index = 1").select("snapshot_id", "artifact_id").distinct()


def p2_chunks(spark, root):
    rows = table(spark, root, "planned_artifact").dropDuplicates(["snapshot_id", "artifact_id"])
    return chunk_rows(rows).select("snapshot_id", "artifact_id", "chunk_index", "chunk_start", "chunk_end", "boundary", "chunk_text")


def p7_ids(spark, root):
    return encode_corpus(table(spark, root, "documents"))


def p7_token_counts(spark, root):
    return p7_ids(spark, root).select(F.size("ids").alias("n")).agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_tokens"), F.max("n").alias("most_tokens"))


QUERIES = {"p2_found": p2_found, "p2_chunks": p2_chunks, "p7_ids": p7_ids, "p7_token_counts": p7_token_counts}
SQL = {"p2_found": "SELECT DISTINCT snapshot_id, artifact_id FROM planned_artifact WHERE length(text) > char_limit"}
