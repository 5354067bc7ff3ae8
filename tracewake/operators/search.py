"""Hybrid search of many changes at once, evidence checked against the snapshot, and whole investigations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewake.functions import text
from tracewake.operators import evidence, fusion, graph, lexical, semantic
from tracewake.session import cut_lineage


@dataclass
class Corpus:
    """The indexed side: all frames have the columns ``by`` that name a snapshot.

    files: ``by, artifact_id, version_id, path, kind, sha256``; content_index: ``token, sha256`` or ``tokens, sha256``; path_index: ``token, artifact_id``;
    edges: ``by, source_id, target_id, kind``; chunks: ``model_id, by, artifact_id, chunk_index, input_hash``; embeddings: ``model_id, input_hash, dimensions, vector``.
    """

    files: DataFrame
    content_index: DataFrame
    path_index: DataFrame
    edges: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    by: list[str]


@dataclass
class Run:
    """Rankings of one search: everything that evidence is made of, so that no part of the search is done again."""

    matches: DataFrame
    signals: DataFrame
    best: DataFrame
    deterministic: DataFrame
    semantic: DataFrame
    fused: DataFrame
    k: int


def change_terms(changes: DataFrame, by: list[str], symbols: bool = False) -> DataFrame:
    """``by, term`` of changes (``by, description, changed``, and ``symbols`` if told): terms of the description, of base names and of symbols."""
    query = text.lexical_query_text(F.coalesce("description", F.lit("")), F.col("changed"))
    return changes.select(*by, F.explode(text.query_terms(query, F.col("symbols") if symbols else None)).alias("term"))


def search_hybrid(corpus: Corpus, changes: DataFrame, queries: DataFrame, k: int = fusion.K, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Run:
    """Terms and imports, similarity, and their fusion, for each change in its snapshot.

    ``changes`` has ``by, description, changed`` (paths) and perhaps ``symbols``; ``queries`` has ``by, model_id, vector``, the embedded change. Each stage is partitioned by
    snapshot; changed files rank like all others, and a caller that does not want them leaves them out of the result. ``keep`` is given each ranking before the next is made of it:
    with :func:`cut_lineage`, for steps that read the run several times, every part of the search is done once and leaves only what it found.
    """
    by = corpus.by
    matches = lexical.index_matches(corpus.files, change_terms(changes, by, "symbols" in changes.columns), corpus.content_index, corpus.path_index, by)
    matches = keep(matches.drop("matched_terms")).withColumn("matched_terms", F.sort_array(F.array_union("content_terms", "path_terms")))
    seeds = corpus.files.join(changes.select(*by, F.explode("changed").alias("path")).distinct(), [*by, "path"], "left_semi")
    signals = keep(graph.structural_signals(corpus.edges, seeds, by))
    scoped = corpus.files.join(changes.select(*by).distinct(), by, "left_semi")
    deterministic = fusion.deterministic_rank(fusion.deterministic_candidates(matches, graph.signal_counts(signals, by), scoped, by).filter("version_id IS NOT NULL AND (size(matched_terms) > 0 OR n_test_to_source + n_incoming_import + n_outgoing_import > 0)"), by)
    deterministic = keep(deterministic.select(*by, "artifact_id", "version_id", "path", "category", "rank"))
    scored = semantic.chunk_similarity(corpus.chunks, corpus.embeddings, queries, tuple(by)).withColumn("similarity", F.round("similarity", 9))
    best = keep(semantic.best_chunks(scored, by))
    named = best.join(scoped.select(*by, "artifact_id", "version_id", "path"), [*by, "artifact_id"])
    ranked = keep(semantic.semantic_rank(named, by))
    return Run(matches, signals, best, deterministic, ranked, fusion.fuse(deterministic, ranked, by, k), k)


def _judged(fused: DataFrame, run: Run, corpus: Corpus) -> DataFrame:
    """Adds ``problem`` to candidates, null where the snapshot and the run's own rankings bear a candidate out.

    A candidate must be that version and path of that artifact, with the ranks and category of the rankings, and every signal must be an edge of the snapshot.
    """
    by = corpus.by
    key = [*by, "artifact_id"]
    stored = corpus.files.select(*key, F.col("version_id").alias("__version"), F.col("path").alias("__path"))
    det = run.deterministic.select(*key, F.col("rank").alias("__det"), F.col("category").alias("__category"))
    sem = run.semantic.select(*key, F.col("rank").alias("__sem"))
    ids = corpus.files.select(*by, F.col("artifact_id").alias("changed_id")).withColumn("__there", F.lit(True))
    edge = F.when(F.col("signal") == "outgoing-import", F.struct(F.col("changed_id").alias("s"), F.col("artifact_id").alias("t"))).otherwise(F.struct(F.col("artifact_id").alias("s"), F.col("changed_id").alias("t")))
    kind = F.when(F.col("signal") == "test-to-source", "test-to-source").otherwise("imports")
    held = corpus.edges.select(*by, F.col("source_id").alias("__s"), F.col("target_id").alias("__t"), F.col("kind").alias("__kind")).distinct().withColumn("__edge", F.lit(True))
    told = run.signals.select(*by, "artifact_id", "changed_id", edge.alias("e"), kind.alias("__kind")).select(*by, "artifact_id", "changed_id", F.col("e.s").alias("__s"), F.col("e.t").alias("__t"), "__kind")
    loose = told.join(held, [*by, "__s", "__t", "__kind"], "left").join(ids, [*by, "changed_id"], "left").filter("__edge IS NULL OR __there IS NULL").select(*key).distinct().withColumn("__loose", F.lit(True))
    rows = fused.join(stored, key, "left").join(det, key, "left").join(sem, key, "left").join(loose, key, "left")
    problem = (
        F.when(F.col("__version").isNull() | ~F.col("version_id").eqNullSafe(F.col("__version")) | ~F.col("path").eqNullSafe(F.col("__path")), "not in the snapshot")
        .when(~F.col("deterministic_rank").eqNullSafe(F.col("__det")) | ~F.col("deterministic_category").eqNullSafe(F.col("__category")), "not so in the deterministic ranking")
        .when(~F.col("semantic_rank").eqNullSafe(F.col("__sem")), "not so in the semantic ranking").when(F.col("__loose"), "a signal without an edge")
    )
    return rows.select(*[fused[c] for c in fused.columns], problem.alias("problem"))


def inconsistent_candidates(fused: DataFrame, run: Run, corpus: Corpus) -> DataFrame:
    """``by, artifact_id, problem`` of candidates that the snapshot or the run's own rankings do not bear out; none of a sound run."""
    return _judged(fused, run, corpus).select(*corpus.by, "artifact_id", "problem").filter("problem IS NOT NULL")


def construct_evidence(run: Run, corpus: Corpus, changes: DataFrame, model: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """The best candidates of each change that did not change themselves, with fused ranks, and all evidence of these; a candidate that is not borne out is an error."""
    by = corpus.by
    seeds = changes.select(*by, F.explode("changed").alias("path")).distinct()
    # Written down by itself, so that what the ranking moved is gone when the check moves its own.
    best = cut_lineage(evidence.top(run.fused, seeds, by, limit))
    judged = _judged(best, run, corpus)
    checked = judged.withColumn("path", F.when(F.col("problem").isNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("candidate "), F.col("path"), F.lit(": "), F.col("problem"))).cast("string"))).drop("problem")
    named = run.signals.join(corpus.files.select(*by, F.col("artifact_id").alias("changed_id"), F.col("path").alias("changed_path")), [*by, "changed_id"])
    checked = cut_lineage(checked)
    return checked, evidence.evidence_rows(checked, named, run.matches, run.best, by, run.k, model)


def investigate_changes(corpus: Corpus, changes: DataFrame, queries: DataFrame, model: str, limit: int = 20) -> DataFrame:
    """``by, eligible_rank, artifact_id, path, n_evidence, limitations, open_question``: the files most worth a look for each change, with what their evidence cannot show."""
    by = corpus.by
    run = search_hybrid(corpus, changes, queries, keep=cut_lineage)
    best, rows = construct_evidence(run, corpus, changes, model, limit)
    none = F.array().cast("array<string>")
    counted = rows.groupBy(*by, "version_id").agg(F.count("*").alias("n_evidence"))
    signals = graph.signal_counts(run.signals, by).select(*by, "artifact_id", "signals")
    terms = run.matches.select(*by, "artifact_id", "content_terms", "matched_terms")
    full = best.join(signals, [*by, "artifact_id"], "left").join(terms, [*by, "artifact_id"], "left").join(counted, [*by, "version_id"], "left")
    for c in ("content_terms", "matched_terms"):
        full = full.withColumn(c, F.coalesce(c, none))
    return evidence.limitations(full).select(*by, "eligible_rank", "artifact_id", "path", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "limitations", "open_question")
