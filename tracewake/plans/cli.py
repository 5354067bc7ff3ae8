"""Command line: run a query of the registry, digest a table, or investigate a change in a store."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from tracewake.functions import vectors
from tracewake.operators import graph, ingest, lexical, report, search
from tracewake.session import local_session, table


def investigate(spark, root: str, snapshot: int, description: str, changed: list[str], limit: int = 20, embed=None, model: str | None = None) -> dict:
    """The files of a ready snapshot most worth a look when ``changed`` paths change, by terms, imports and similarity.

    ``embed`` turns a text into a vector of ``model``. Without it the change is compared by the stored vector of the first chunk, by hash, of the changed files.
    """
    ingest.require_ready(table(spark, root, "repository_snapshot"), snapshot)
    by = ["snapshot_id"]
    files = ingest.snapshot_artifacts(table(spark, root, "artifact_version").filter(F.col("snapshot_id") == snapshot), table(spark, root, "artifact"))
    contents = table(spark, root, "content").withColumn("sha256", F.lower("sha256")).join(files.select("sha256").distinct(), "sha256", "left_semi")
    found = graph.content_imports(contents).filter("specifier IS NOT NULL").distinct()
    imports = files.join(found, "sha256").select(*by, F.col("artifact_id").alias("source_id"), F.col("path").alias("source_path"), "specifier")
    edges = graph.edges(graph.resolve_imports(imports, files, by), files, by)
    chunks = table(spark, root, "semantic_chunk").filter(F.col("snapshot_id") == snapshot)
    model = model or chunks.agg(F.min("model_id")).first()[0] or "none"
    embeddings = table(spark, root, "semantic_embedding").filter(F.col("model_id") == model)
    chunks = chunks.filter(F.col("model_id") == model)
    seeds = files.filter(F.col("path").isin(changed)).select(*by, "artifact_id")
    if embed:
        words = f"search_query: Change Description: {description}\nFiles Modified:\n" + "\n".join(f"- {p}" for p in changed)
        queries = spark.createDataFrame([(snapshot, model, [float(x) for x in embed(words)])], "snapshot_id long, model_id string, vector array<float>")
    else:
        good = embeddings.filter(vectors.is_valid(F.col("vector"), F.col("dimensions")))
        queries = chunks.join(seeds, [*by, "artifact_id"], "left_semi").join(good, ["model_id", "input_hash"]).groupBy(*by, "model_id").agg(F.min_by("vector", "input_hash").alias("vector"))
    corpus = search.Corpus(files, lexical.content_tokens(contents), lexical.path_tokens(files.select(F.col("artifact_id").alias("id"), "path")), edges, chunks, embeddings, by)
    changes = spark.createDataFrame([(snapshot, description, changed)], "snapshot_id long, description string, changed array<string>")
    best, rows = search.construct_evidence(search.settled(search.search_hybrid(corpus, changes, queries)), corpus, changes, model, limit)
    return report.investigation(best, rows, description, changed, limit)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewake")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a query and write its result")
    run.add_argument("query")
    run.add_argument("root")
    run.add_argument("out")
    dig = commands.add_parser("digest", help="row count and digest of a table")
    dig.add_argument("path")
    look = commands.add_parser("investigate", help="rank the files of a snapshot for a change")
    look.add_argument("root")
    look.add_argument("snapshot", type=int)
    look.add_argument("--description", default="")
    look.add_argument("--changed", action="append", required=True)
    look.add_argument("--limit", type=int, default=20)
    look.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    spark = local_session()
    if args.command == "run":
        from tracewake.plans import registry

        registry.core_queries()[args.query](spark, args.root).write.mode("errorifexists").parquet(args.out)
    elif args.command == "digest":
        df = spark.read.parquet(args.path)
        print(json.dumps(ingest.table_digest(df, df.columns[:1]).first().asDict()))
    else:
        found = investigate(spark, args.root, args.snapshot, args.description, args.changed, args.limit)
        print(json.dumps(found, indent=2, ensure_ascii=False) if args.json else report.markdown(found))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
