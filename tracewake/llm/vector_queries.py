"""Queries on vectors (4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewake.llm.neighbours import mutual_pairs, nearest
from tracewake.session import table

LEAST = 0.95


def p4_found(spark, root):
    # Neighbours as near as LEAST lie in the nearest few lists.
    found = nearest(table(spark, root, "semantic_embedding"), k=10, least=LEAST, query_lists=4, query_ratio=1.2)
    return mutual_pairs(found, LEAST).select(F.col("model").alias("model_id"), F.col("a").alias("input_hash_a"), F.col("b").alias("input_hash_b"))


def p4_neighbours(spark, root):
    """The ten nearest of every vector whose id is divisible by 20, against all vectors of ``embeddings``."""
    rows = table(spark, root, "embeddings").withColumn("model", F.lit("embeddings"))
    found = nearest(rows, k=10, model="model", key="vec_id", vector="embedding", dimensions=None, queries=F.col("key").cast("bigint") % 20 == 0, query_lists=32, query_ratio=1.6, copies=True)
    return found.select(F.col("key").cast("bigint").alias("vec_id"), F.col("neighbour").cast("bigint").alias("neighbour_id"), "similarity", "rank")


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
SQL: dict[str, str] = {}
