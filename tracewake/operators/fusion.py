"""Deterministic ranking and the fusion of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewake.functions import text
from tracewake.operators.lexical import strength_order

K = 60


def deterministic_candidates(matches: DataFrame, signals: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """Lexical matches and structural signals of each artifact in one row: a full outer join on the artifact."""
    none = F.array().cast("array<string>")
    counts = [c for c in signals.columns if c.startswith("n_")]
    terms = matches.select(*by, "artifact_id", "content_terms", "path_terms", "matched_terms")
    both = terms.join(signals, [*by, "artifact_id"], "full_outer").join(files.select(*by, "artifact_id", "version_id", "path", "kind"), [*by, "artifact_id"])
    for c in ("content_terms", "path_terms", "matched_terms"):
        both = both.withColumn(c, F.coalesce(c, none))
    for c in counts:
        both = both.withColumn(c, F.coalesce(c, F.lit(0)))
    return both


def deterministic_rank(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``lexical_category, category, rank`` within ``by``."""
    lexical = F.when(F.size("matched_terms") > 0, text.lexical_category(F.size("matched_terms"), F.size("path_terms")))
    incoming = (F.col("n_test_to_source") > 0) | (F.col("n_incoming_import") > 0)
    rows = candidates.withColumn("lexical_category", lexical).withColumn("category", text.deterministic_category(F.col("lexical_category"), incoming, F.col("n_outgoing_import") > 0))
    order = Window.partitionBy(*by).orderBy(text.precedence(F.col("category")), *strength_order())
    return rows.withColumn("rank", F.row_number().over(order))


def contribution(rank, k: int):
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank), F.lit(0.0))


def fuse(deterministic: DataFrame, semantic: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Reciprocal rank fusion of two rankings with ``by, artifact_id, version_id, path, rank`` (and ``category`` in the first).

    Order: score, category of the deterministic ranking (none is last), path, artifact. Rankings that disagree on what an artifact is are an error.
    """
    if k < 1:
        raise ValueError("k must be positive")
    d = deterministic.select(*by, "artifact_id", F.col("version_id").alias("dv"), F.col("path").alias("dp"), F.col("rank").alias("deterministic_rank"), F.col("category").alias("deterministic_category"))
    s = semantic.select(*by, "artifact_id", F.col("version_id").alias("sv"), F.col("path").alias("sp"), F.col("rank").alias("semantic_rank"))
    both = d.join(s, [*by, "artifact_id"], "full_outer")
    agree = (F.coalesce("dv", "sv") == F.coalesce("sv", "dv")) & (F.coalesce("dp", "sp") == F.coalesce("sp", "dp"))
    score = contribution(F.col("deterministic_rank"), k) + contribution(F.col("semantic_rank"), k)
    rows = both.select(
        *by, "artifact_id", F.when(agree, F.coalesce("dv", "sv")).otherwise(F.raise_error(F.lit("the rankings disagree on an artifact")).cast("long")).alias("version_id"),
        F.coalesce("dp", "sp").alias("path"), score.alias("rrf_score"), "deterministic_rank", "semantic_rank", "deterministic_category",
    )
    order = Window.partitionBy(*by).orderBy(F.desc("rrf_score"), text.precedence(F.col("deterministic_category")), "path", "artifact_id")
    return rows.withColumn("rank", F.row_number().over(order))


def tiered(fused: DataFrame, by: list[str]) -> DataFrame:
    """Evidence-aware order: strong deterministic categories, weaker ones, semantic only; then the score and the path."""
    place = text.precedence(F.col("deterministic_category"))
    rows = fused.withColumn("tier", F.when(F.col("deterministic_rank").isNull(), 3).when(place <= 2, 1).otherwise(2))
    order = Window.partitionBy(*by).orderBy("tier", F.desc("rrf_score"), "path", "artifact_id")
    return rows.withColumn("tier_rank", F.row_number().over(order))


def score_then_level(fused: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``level`` (place of the deterministic category from 1, null without one) and ``h2_rank``: by score, then by level, none last, then by path."""
    level = F.when(F.col("deterministic_category").isNotNull(), text.precedence(F.col("deterministic_category")))
    order = Window.partitionBy(*by).orderBy(F.desc("rrf_score"), F.coalesce("level", F.lit(99)), "path", "artifact_id")
    return fused.withColumn("level", level).withColumn("h2_rank", F.row_number().over(order))


def union_coverage(fused: DataFrame, truth: DataFrame, by: list[str], ks=(1, 3, 5, 10, 20)) -> DataFrame:
    """Of each group's true artifacts, those within the first K of either ranking."""
    best = F.least(F.coalesce("deterministic_rank", F.lit(2**31 - 1)), F.coalesce("semantic_rank", F.lit(2**31 - 1)))
    rows = truth.join(fused.select(*by, "artifact_id", best.alias("best")), [*by, "artifact_id"], "left")
    return rows.groupBy(*by).agg(F.count("*").alias("n_truth"), *[F.count_if(F.coalesce(F.col("best") <= k, F.lit(False))).alias(f"found_{k}") for k in ks])
