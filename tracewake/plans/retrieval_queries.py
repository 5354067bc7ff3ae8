"""Queries on ingestion, lexical, structural and semantic retrieval, and fusion, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewake.functions import paths, text, vectors
from tracewake.operators import evidence, fusion, graph, history, ingest, lexical, semantic
from tracewake.operators.history import evidence_tier
from tracewake.operators.snapshots import diff_snapshots
from tracewake.session import table

#: The change that the retrieval queries ask about.
TERMS = ["receipt", "voucher", "session", "coupon", "ledger"]
#: Files of a snapshot in the queries on documents.
PER_SNAPSHOT = 500
_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
#: Tokens of a column in DuckDB: the camelCase break is written as an underscore first.
_BROKEN = "string_split(regexp_replace(i, '(\\p{{Ll}})(\\p{{Lu}})', '\\1_\\2', 'g'), '_')"
_TOKENS = (
    "list_distinct(flatten([[lower(x) for x in " + _BROKEN + " if length(x) > 0]"
    " || CASE WHEN len([x for x in " + _BROKEN + " if length(x) > 0]) > 1 THEN [lower(replace(i, '_', ''))] ELSE [] END"
    " for i in regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}_]+')]))"
)


def tokens_sql(column: str) -> str:
    return _TOKENS.format(column)


def _docs(spark, root):
    """documents as files: half tests and documents, in snapshots of PER_SNAPSHOT files."""
    n = F.col("doc_id")
    folder = F.concat(F.lit("src/m"), (n % 7).cast("string"), F.lit("/doc"), n.cast("string"))
    path = F.when(n % 5 == 0, F.concat(F.lit("docs/doc"), n.cast("string"), F.lit(".md"))).when(n % 5 == 1, F.concat(folder, F.lit(".test.ts"))).otherwise(F.concat(folder, F.lit(".ts")))
    return table(spark, root, "documents").select(
        F.floor(n / PER_SNAPSHOT).cast("int").alias("snapshot_id"), n.alias("artifact_id"), n.alias("version_id"), path.alias("path"), F.when(n % 5 == 0, "document").otherwise("code").alias("kind"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "text"
    )


_DOCS = f"""files AS (SELECT doc_id // {PER_SNAPSHOT} AS snapshot_id, doc_id AS artifact_id, doc_id AS version_id, text,
  CASE doc_id % 5 WHEN 0 THEN 'docs/doc' || doc_id || '.md' WHEN 1 THEN 'src/m' || (doc_id % 7) || '/doc' || doc_id || '.test.ts'
  ELSE 'src/m' || (doc_id % 7) || '/doc' || doc_id || '.ts' END AS path, CASE WHEN doc_id % 5 = 0 THEN 'document' ELSE 'code' END AS kind FROM documents)"""


def _imports(files):
    """File i names the files 7i + 3 and 3i + 1 (modulo their number) of its snapshot relative to its folder, the second without an extension."""
    n = F.col("artifact_id")
    base = F.col("snapshot_id").cast("long") * PER_SNAPSHOT
    a, b = base + (n * 7 + 3) % PER_SNAPSHOT, base + (n * 3 + 1) % PER_SNAPSHOT
    spec = lambda t, end: F.concat(F.lit("../m"), (t % 7).cast("string"), F.lit("/./doc"), t.cast("string"), F.lit(end))
    return files.filter("kind = 'code'").select("snapshot_id", n.alias("source_id"), F.col("path").alias("source_path"), F.explode(F.array(spec(a, ".js"), spec(b, ""), F.lit("node:fs"))).alias("specifier"))


_EDGES = f"""{_DOCS}, wanted AS (
  SELECT artifact_id AS source_id, path AS source_path, snapshot_id * {PER_SNAPSHOT} + (artifact_id * 7 + 3) % {PER_SNAPSHOT} AS t, '.js' AS e FROM files WHERE kind = 'code'
  UNION ALL SELECT artifact_id, path, snapshot_id * {PER_SNAPSHOT} + (artifact_id * 3 + 1) % {PER_SNAPSHOT}, '' FROM files WHERE kind = 'code'),
resolved AS (SELECT DISTINCT w.source_id, f.artifact_id AS target_id, '../m' || (t % 7) || '/./doc' || t || e AS specifier, source_path
  FROM wanted w JOIN files f ON f.path = 'src/m' || (t % 7) || '/doc' || t || '.ts' WHERE w.source_id <> f.artifact_id),
edges AS (SELECT DISTINCT source_id, target_id, 'imports' AS kind FROM resolved
  UNION ALL SELECT DISTINCT source_id, target_id, 'test-to-source' FROM resolved WHERE source_path LIKE '%.test.%')"""
_CHANGED = "changed AS (SELECT artifact_id AS changed_id FROM files WHERE kind = 'code' AND artifact_id % 50 = 2)"
_SIGNALS = f"""{_EDGES}, {_CHANGED}, signals AS (
  SELECT source_id AS artifact_id, CASE WHEN max(kind = 'test-to-source') THEN 'test-to-source' ELSE 'incoming-import' END AS signal, target_id AS changed_id
  FROM edges JOIN changed ON target_id = changed_id GROUP BY source_id, target_id
  UNION ALL SELECT DISTINCT target_id, 'outgoing-import', source_id FROM edges JOIN changed ON source_id = changed_id WHERE kind = 'imports')"""
_MATCHES = f"""matches AS (SELECT snapshot_id, artifact_id, path, list_sort(list_intersect({tokens_sql("text")}, {_LIST})) AS content_terms, list_sort(list_intersect({tokens_sql("path")}, {_LIST})) AS path_terms FROM files),
matched AS (SELECT *, list_sort(list_distinct(content_terms || path_terms)) AS matched_terms FROM matches WHERE len(content_terms) + len(path_terms) > 0)"""
_LEXCAT = "CASE WHEN len(path_terms) > 0 AND len(matched_terms) >= 3 THEN 'path-and-multi-content' WHEN len(matched_terms) >= 5 THEN 'high-content-density' WHEN len(path_terms) > 0 THEN 'path-only' WHEN len(matched_terms) >= 2 THEN 'multiple-terms' WHEN len(matched_terms) >= 1 THEN 'single-term' END"
_ORDER = {n: "CASE {0} " + " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(names)) + f" ELSE {len(names) + 1} END" for n, names in (("lex", text.LEXICAL), ("det", text.CATEGORIES))}
_STRENGTH = "len(matched_terms) DESC, len(path_terms) DESC, length(path), path, artifact_id"


def _graph(spark, root):
    files = _docs(spark, root)
    by = ["snapshot_id"]
    resolved = graph.resolve_imports(_imports(files), files, by)
    changed = files.filter("kind = 'code' AND artifact_id % 50 = 2")
    edge = graph.edges(resolved, files, by)
    return files, resolved, edge, changed, graph.structural_signals(edge, changed, by)


def _matches(files):
    return lexical.lexical_matches(files.drop("text"), files.select("sha256", "text"), TERMS)


def _deterministic(spark, root):
    files, _, _, changed, signals = _graph(spark, root)
    by = ["snapshot_id"]
    found = fusion.deterministic_candidates(_matches(files), graph.signal_counts(signals, by), files, by)
    return files, changed, signals, fusion.deterministic_rank(found, by)


_DET = f"""{_SIGNALS}, {_MATCHES}, counts AS (SELECT artifact_id, max(signal <> 'outgoing-import') AS incoming, max(signal = 'outgoing-import') AS outgoing FROM signals GROUP BY 1),
det0 AS (SELECT f.snapshot_id, f.artifact_id, f.version_id, f.path, coalesce(m.content_terms, []) AS content_terms, coalesce(m.path_terms, []) AS path_terms, coalesce(m.matched_terms, []) AS matched_terms, coalesce(c.incoming, false) AS incoming, coalesce(c.outgoing, false) AS outgoing
  FROM files f LEFT JOIN matched m USING (artifact_id) LEFT JOIN counts c USING (artifact_id) WHERE m.artifact_id IS NOT NULL OR c.artifact_id IS NOT NULL),
det1 AS (SELECT *, {_LEXCAT} AS lexical_category FROM det0),
det2 AS (SELECT *, CASE WHEN incoming THEN 'critical-structural' WHEN lexical_category IN ('path-and-multi-content', 'high-content-density') THEN lexical_category WHEN outgoing THEN 'weak-structural' ELSE lexical_category END AS category FROM det1),
det AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY {_ORDER["det"].format("category")}, {_STRENGTH}) AS rank FROM det2)"""


def _semantic(spark, root):
    """Similarity of each document to the change by counts of the terms: an embedding that needs no model."""
    files = _docs(spark, root)
    vector = semantic.word_count_vector(F.coalesce("text", F.lit("")), TERMS)
    query = F.array(*[F.lit(float(i + 1)) for i in range(len(TERMS))], F.lit(0.01))
    best = files.select("snapshot_id", "artifact_id", "version_id", "path", F.round(vectors.cosine(vector, query), 9).alias("similarity"))
    return semantic.semantic_rank(best, ["snapshot_id"])


_VEC = ", ".join(f"CAST(len(string_split(lower(coalesce(text, '')), '{t}')) - 1 AS DOUBLE)" for t in TERMS)
_SEM = f"""vec AS (SELECT snapshot_id, artifact_id, version_id, path, [{_VEC}, CAST(CAST(0.01 AS FLOAT) AS DOUBLE)] AS v, [{", ".join(f"{i + 1}.0::DOUBLE" for i in range(len(TERMS)))}, 0.01::DOUBLE] AS q FROM files),
sims AS (SELECT snapshot_id, artifact_id, version_id, path, round(list_sum([v[i] * q[i] for i in range(1, {len(TERMS) + 2})]) / (sqrt(list_sum([x * x for x in v])) * sqrt(list_sum([x * x for x in q]))), 9) AS similarity FROM vec),
sem AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY similarity DESC, path, artifact_id) AS rank FROM sims)"""


def _fused(spark, root, k=fusion.K):
    files, changed, signals, det = _deterministic(spark, root)
    return files, changed, signals, fusion.fuse(det, _semantic(spark, root), ["snapshot_id"], k)


def _fused_sql(k: int = fusion.K) -> str:
    return f"""{_DET}, {_SEM}, fused0 AS (SELECT coalesce(d.snapshot_id, s.snapshot_id) AS snapshot_id, coalesce(d.artifact_id, s.artifact_id) AS artifact_id, coalesce(d.path, s.path) AS path, d.rank AS deterministic_rank, s.rank AS semantic_rank, d.category AS deterministic_category,
  coalesce(1.0::DOUBLE / ({k} + d.rank), 0) + coalesce(1.0::DOUBLE / ({k} + s.rank), 0) AS rrf_score FROM det d FULL OUTER JOIN sem s ON s.artifact_id = d.artifact_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY rrf_score DESC, {_ORDER["det"].format("deterministic_category")}, path, artifact_id) AS rank FROM fused0)"""


def tokenize_documents(spark, root):
    return table(spark, root, "documents").select("doc_id", F.explode(text.tokenize(F.col("text"))).alias("token"))


def searchable_terms(spark, root):
    return table(spark, root, "documents").select("doc_id", F.explode(text.query_terms(F.col("text"))).alias("term"))


def content_token_index(spark, root):
    return lexical.content_tokens(table(spark, root, "content"))


def document_frequency(spark, root):
    return lexical.content_frequency(table(spark, root, "content"))


def path_frequency(spark, root):
    return lexical.document_frequency(path_token_index(spark, root), "artifact_id")


def path_token_index(spark, root):
    return lexical.path_tokens(table(spark, root, "artifact"))


def _ready_files(spark, root):
    ready = table(spark, root, "repository_snapshot").filter("status = 'ready'").select(F.col("id").alias("snapshot_id")).distinct()
    return ingest.snapshot_artifacts(table(spark, root, "artifact_version"), table(spark, root, "artifact")).join(ready, "snapshot_id")


_READY = "(SELECT DISTINCT v.id AS version_id, v.artifact_id, v.snapshot_id, lower(v.content_sha256) AS sha256, a.path FROM artifact_version v JOIN (SELECT id, min(path) AS path FROM artifact GROUP BY 1) a ON a.id = v.artifact_id WHERE v.snapshot_id IN (SELECT id FROM repository_snapshot WHERE status = 'ready'))"


def snapshot_listing(spark, root):
    return _ready_files(spark, root).select("snapshot_id", "version_id", "path", "sha256")


def lexical_search_ranked(spark, root):
    found = lexical.lexical_matches(_ready_files(spark, root), table(spark, root, "content"), TERMS)
    return lexical.lexical_rank(found, ["snapshot_id"]).select("snapshot_id", "version_id", "category", F.size("matched_terms").alias("n_terms"), F.size("path_terms").alias("n_path_terms"), "rank")


def lexical_categories(spark, root):
    return lexical_search_ranked(spark, root).groupBy("category").agg(F.count("*").alias("n"))


_LEXICAL = f"""WITH files AS {_READY}, c AS (SELECT DISTINCT lower(sha256) AS sha256, list_sort(list_intersect({tokens_sql("text")}, {_LIST})) AS ct FROM content),
m AS (SELECT f.*, coalesce(c.ct, []) AS content_terms, list_sort(list_intersect({tokens_sql("path")}, {_LIST})) AS path_terms FROM files f LEFT JOIN c USING (sha256)),
n AS (SELECT *, list_distinct(content_terms || path_terms) AS matched_terms FROM m WHERE len(content_terms) + len(path_terms) > 0),
k AS (SELECT *, {_LEXCAT} AS category FROM n),
r AS (SELECT snapshot_id, version_id, category, len(matched_terms) AS n_terms, len(path_terms) AS n_path_terms, row_number() OVER (PARTITION BY snapshot_id ORDER BY {_ORDER["lex"].format("category")}, {_STRENGTH}) AS rank FROM k)"""


def file_policy(spark, root):
    n = F.col("id")
    entries = table(spark, root, "artifact").dropDuplicates(["id"]).select(
        "id", "path", F.when(n % 97 == 0, "120000").when(n % 89 == 0, "160000").otherwise("100644").alias("mode"), F.when(n % 83 == 0, None).otherwise((n * 7919) % 1100000).alias("size")
    )
    more = table(spark, root, "excluded_entry").distinct().select((F.col("snapshot_id") + 10**9).alias("id"), "path", F.lit("100644").alias("mode"), F.lit(10).cast("long").alias("size"))
    return ingest.classify_tree(entries.unionByName(more)).select("id", "path", "kind", "reason")


_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1))"
_KIND = f"CASE WHEN {_EXT} IN ('.ts','.tsx','.mts','.cts','.js','.jsx','.mjs','.cjs') THEN 'code' WHEN {_EXT} IN ('.md','.mdx','.txt') THEN 'document' WHEN {_EXT} IN ('.json','.yaml','.yml') THEN 'config' END"
_GENERATED = "(len(list_intersect(string_split(path, '/')[:-2], ['node_modules','dist','build','out','coverage','.next','.turbo'])) > 0 OR lower(regexp_extract(path, '[^/]*$')) IN ('package-lock.json','npm-shrinkwrap.json','pnpm-lock.yaml') OR regexp_matches(lower(path), '\\.min\\.(js|mjs|cjs)$'))"
_POLICY = f"""WITH e AS (SELECT DISTINCT id, path, CASE WHEN id % 97 = 0 THEN '120000' WHEN id % 89 = 0 THEN '160000' ELSE '100644' END AS mode, CASE WHEN id % 83 = 0 THEN NULL ELSE (id * 7919) % 1100000 END AS size FROM artifact
  UNION ALL SELECT snapshot_id + 1000000000, path, '100644', 10 FROM (SELECT DISTINCT * FROM excluded_entry)),
r AS (SELECT id, path, {_KIND} AS k, CASE WHEN mode = '120000' THEN 'symlink' WHEN mode = '160000' THEN 'submodule' WHEN {_GENERATED} THEN 'generated' WHEN {_KIND} IS NULL THEN 'unsupported_type' WHEN size IS NULL OR size > 1048576 THEN 'oversized' END AS reason FROM e)
SELECT id, path, CASE WHEN reason IS NULL THEN k END AS kind, reason FROM r"""


def exclusion_histogram(spark, root):
    return table(spark, root, "excluded_entry").distinct().groupBy("reason").agg(F.count("*").alias("n"))


def path_classes(spark, root):
    rows = table(spark, root, "artifact").filter("kind IS NOT NULL").dropDuplicates(["id"])
    return rows.select("id", paths.path_class(F.col("path"), F.col("kind")).alias("class"), paths.is_test(F.col("path")).alias("is_test"), paths.dialect(F.col("path")).alias("dialect"), paths.is_portable(F.col("path")).alias("portable"))


def content_sha(spark, root):
    row = ingest.normalise_content(F.col("text").cast("binary"))
    return table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", row.alias("c")).select("doc_id", "c.sha256", "c.byte_length", "c.reason")


def content_dedup(spark, root):
    rows = table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return ingest.new_contents(rows.select("sha256"), rows.filter("doc_id % 3 = 0")).select("sha256")


def unindexed_contents(spark, root):
    rows = table(spark, root, "content").select(F.lower("sha256").alias("sha256")).distinct()
    return lexical.unindexed(rows, rows.filter(F.substring("sha256", 1, 1).isin("0", "1", "2", "3", "4", "5", "6", "7")))


def artifact_ids(spark, root):
    rows = table(spark, root, "artifact").dropDuplicates(["id"])
    return ingest.artifact_ids(rows, rows.filter("id % 3 = 0")).groupBy("repository_id").agg(F.count("*").alias("n"), F.max("id").alias("top"))


def snapshot_compare(spark, root):
    rows = table(spark, root, "documents")
    base = rows.filter("doc_id % 7 <> 0").select("doc_id", "text")
    head = rows.filter("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"))
    return diff_snapshots(base, head, ["doc_id"]).select("doc_id", "change_kind")


def module_resolution(spark, root):
    return _graph(spark, root)[1].select("source_id", "specifier", "target_id")


def import_edges(spark, root):
    return _graph(spark, root)[2].select("source_id", "target_id", "kind")


def structural_signals(spark, root):
    return _graph(spark, root)[4].select("artifact_id", "signal", "changed_id")


def signal_counts(spark, root):
    return graph.signal_counts(_graph(spark, root)[4], ["snapshot_id"]).select("artifact_id", "n_test_to_source", "n_incoming_import", "n_outgoing_import")


def import_scan(spark, root):
    return graph.content_imports(table(spark, root, "content"))


def snapshot_import_edges(spark, root):
    """Edges of the real files of every ready snapshot, from the imports that their text declares."""
    files = _ready_files(spark, root)
    found = graph.content_imports(table(spark, root, "content")).filter("specifier IS NOT NULL").distinct()
    code = files.filter(paths.dialect(F.col("path")).isNotNull())
    imports = code.join(found, "sha256").select("snapshot_id", F.col("artifact_id").alias("source_id"), F.col("path").alias("source_path"), "specifier")
    return graph.edges(graph.resolve_imports(imports, files, ["snapshot_id"]), files, ["snapshot_id"])


def deterministic_rank(spark, root):
    return _deterministic(spark, root)[3].select("artifact_id", "lexical_category", "category", "rank")


def _chunk_scores(spark, root):
    e = table(spark, root, "semantic_embedding").filter(vectors.is_valid(F.col("vector"), F.col("dimensions")))
    queries = e.groupBy("model_id").agg(F.min_by("vector", "input_hash").alias("vector"))
    return semantic.chunk_similarity(table(spark, root, "semantic_chunk"), e, queries)


def cosine_chunks(spark, root):
    return _chunk_scores(spark, root).select("model_id", "snapshot_id", "artifact_id", "chunk_index", F.round("similarity", 6).alias("similarity"))


def best_chunk(spark, root):
    rounded = _chunk_scores(spark, root).withColumn("similarity", F.round("similarity", 6))
    return semantic.best_chunks(rounded, ["model_id", "snapshot_id"]).select("model_id", "snapshot_id", "artifact_id", "similarity", "best_chunk_index", "n_chunks")


def semantic_rank(spark, root):
    named = table(spark, root, "artifact").groupBy(F.col("id").alias("artifact_id")).agg(F.min("path").alias("path"))
    return semantic.semantic_rank(best_chunk(spark, root).join(named, "artifact_id"), ["model_id", "snapshot_id"]).select("model_id", "snapshot_id", "artifact_id", "rank")


_CHUNKS = """WITH e AS (SELECT DISTINCT model_id, input_hash, [x::DOUBLE for x in vector] AS v FROM semantic_embedding WHERE vector IS NOT NULL AND len(vector) = dimensions AND len([x for x in vector if isnan(x)]) = 0 AND len([x for x in vector if x <> 0]) > 0),
q AS (SELECT model_id, arg_min(v, input_hash) AS q FROM e GROUP BY 1),
s AS (SELECT e.model_id, input_hash, round(list_sum([v[i] * q[i] for i in range(1, len(v) + 1)]) / (sqrt(list_sum([x * x for x in v])) * sqrt(list_sum([x * x for x in q]))), 6) AS similarity FROM e JOIN q USING (model_id)),
c AS (SELECT DISTINCT * FROM semantic_chunk), scored AS (SELECT c.model_id, snapshot_id, artifact_id, chunk_index, similarity FROM c JOIN s USING (model_id, input_hash)),
best AS (SELECT model_id, snapshot_id, artifact_id, max(similarity) AS similarity, arg_min(chunk_index, (-similarity, chunk_index)) AS best_chunk_index, count(*) AS n_chunks FROM scored GROUP BY 1, 2, 3)"""


def rrf_fuse(spark, root):
    return _fused(spark, root)[3].select("artifact_id", F.round("rrf_score", 9).alias("score"), "deterministic_rank", "semantic_rank", "rank")


def rrf_k10(spark, root):
    return _fused(spark, root, 10)[3].select("artifact_id", "rank")


def hybrid_h1(spark, root):
    files, _, _, fused = _fused(spark, root)
    truth = files.filter("artifact_id % 13 = 0").select("snapshot_id", "artifact_id")
    return fusion.union_coverage(fused, truth, ["snapshot_id"])


def hybrid_h3(spark, root):
    return fusion.tiered(_fused(spark, root)[3], ["snapshot_id"]).select("artifact_id", "tier", "tier_rank")


def eligible_rank(spark, root):
    _, changed, _, fused = _fused(spark, root)
    return evidence.eligible_rank(fused, changed, ["snapshot_id"]).select("artifact_id", "rank", "eligible_rank")


def evidence_topk(spark, root):
    _, changed, _, fused = _fused(spark, root)
    return evidence.top(fused, changed, ["snapshot_id"], 20).select("artifact_id", "path", "eligible_rank")


def fusion_contributions(spark, root):
    f = evidence.fusion_evidence(_fused(spark, root)[3], fusion.K)
    return f.select("evidence_id", F.round("deterministic_contribution", 9).alias("deterministic"), F.round("semantic_contribution", 9).alias("semantic"))


def evidence_bundle(spark, root):
    """All evidence of the twenty best files, as sentences."""
    files, changed, signals, fused = _fused(spark, root)
    by = ["snapshot_id"]
    best = evidence.top(fused, changed, by, 20)
    named = signals.join(files.select("snapshot_id", F.col("artifact_id").alias("changed_id"), F.col("path").alias("changed_path")), ["snapshot_id", "changed_id"])
    chunks = _semantic(spark, root).select(*by, "artifact_id", "similarity", F.lit(0).alias("best_chunk_index"), F.lit(1).alias("n_chunks"))
    return evidence.evidence_rows(best, named, _matches(files), chunks, by, fusion.K, "word-counts").select("version_id", "ordinal", "type", "id", "sentence")


def code_split(spark, root):
    """Parts of every content as a code file: from one declaration to the next."""
    part = F.explode(semantic.split_parts(F.lit("a.ts"), F.coalesce("text", F.lit(""))))
    return table(spark, root, "content").select(F.lower("sha256").alias("sha256"), part.alias("part")).groupBy("sha256").agg(F.count("*").alias("n_parts"), F.sum(F.length("part")).alias("n_chars"))


def chunk_reconstruction(spark, root):
    """How many files were cut into embedding inputs, and how many their reconstructed chunks give back whole."""
    files = _docs(spark, root).filter("text IS NOT NULL").select("artifact_id", "path", "text")
    chunks = semantic.chunk_files(files, 1200).select("artifact_id", "chunk_index", "input_hash")
    made = semantic.reconstruct_chunks(files, chunks, 1200)
    each = made.groupBy("artifact_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda c: c["chunk_text"]), "").alias("all"))
    # Lines end with a line feed in chunks, the last one too.
    same = each.join(files, "artifact_id").select(((F.col("all") == F.col("text")) | (F.col("all") == F.concat("text", F.lit("\n")))).alias("same"))
    return same.agg(F.count("*").alias("n_files"), F.count_if("same").alias("n_rebuilt"))


def tfidf_rank(spark, root):
    return history.tfidf_rank(_matches(_docs(spark, root)), ["snapshot_id"]).select("artifact_id", "tfidf", "rank")


def evidence_tiers(spark, root):
    det = _deterministic(spark, root)[3]
    structural = (F.col("n_test_to_source") + F.col("n_incoming_import") + F.col("n_outgoing_import")) > 0
    return det.select(evidence_tier(structural, F.size("matched_terms"), F.size("path_terms")).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


def markdown_split(spark, root):
    part = F.explode(semantic.split_parts(F.lit("a.md"), F.coalesce("text", F.lit(""))))
    return table(spark, root, "documents").select("doc_id", part.alias("part")).groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.sum(F.length("part")).alias("n_chars"))


def chunk_documents(spark, root):
    return semantic.chunk_files(_docs(spark, root).select("artifact_id", "path", "text"), 1200).select("artifact_id", "chunk_index", "input_hash", F.length("input").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_documents, searchable_terms, content_token_index, document_frequency, path_frequency, path_token_index, snapshot_listing, lexical_search_ranked, lexical_categories, file_policy, exclusion_histogram, path_classes, content_sha,
        content_dedup, unindexed_contents, artifact_ids, snapshot_compare, module_resolution, import_edges, structural_signals, signal_counts, import_scan, snapshot_import_edges, deterministic_rank, cosine_chunks, best_chunk,
        semantic_rank, rrf_fuse, rrf_k10, hybrid_h1, hybrid_h3, eligible_rank, evidence_topk, fusion_contributions, evidence_bundle, tfidf_rank, evidence_tiers, markdown_split, code_split, chunk_documents, chunk_reconstruction,
    )
}
_TRUTH = ", ".join(f"count(*) FILTER (WHERE least(coalesce(deterministic_rank, 2147483647), coalesce(semantic_rank, 2147483647)) <= {k}) AS found_{k}" for k in (1, 3, 5, 10, 20))
SQL = {
    "tokenize_documents": f"SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents",
    "searchable_terms": f"SELECT doc_id, unnest([t for t in {tokens_sql('text')} if length(t) >= 3 AND NOT list_contains({STOP}, t)]) AS term FROM documents",
    "content_token_index": f"SELECT unnest({tokens_sql('text')}) AS token, lower(sha256) AS sha256 FROM content",
    "document_frequency": f"SELECT token, count(DISTINCT sha256) AS document_frequency FROM (SELECT unnest({tokens_sql('text')}) AS token, lower(sha256) AS sha256 FROM content) GROUP BY 1",
    "path_frequency": f"SELECT token, count(DISTINCT id) AS document_frequency FROM (SELECT unnest({tokens_sql('path')}) AS token, id FROM artifact) GROUP BY 1",
    "path_token_index": f"SELECT unnest({tokens_sql('path')}) AS token, id AS artifact_id FROM (SELECT DISTINCT id, path FROM artifact)",
    "snapshot_listing": f"SELECT snapshot_id, version_id, path, sha256 FROM {_READY}",
    "lexical_search_ranked": _LEXICAL + " SELECT * FROM r",
    "lexical_categories": _LEXICAL + " SELECT category, count(*) AS n FROM r GROUP BY 1",
    "file_policy": _POLICY,
    "exclusion_histogram": "SELECT reason, count(*) AS n FROM (SELECT DISTINCT * FROM excluded_entry) GROUP BY 1",
    "path_classes": """SELECT DISTINCT id, CASE kind WHEN 'code' THEN CASE WHEN path LIKE '%.test.%' OR path LIKE '%.spec.%' OR len(list_intersect(string_split(path, '/')[:-2], ['test', 'tests', '__tests__'])) > 0 THEN 'test' ELSE 'source' END
      WHEN 'document' THEN CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '^(?i:changelog|changes|history)') OR path LIKE '.changeset/%' THEN 'ignored' ELSE 'doc' END ELSE 'ignored' END AS class,
      path LIKE '%.test.%' OR path LIKE '%.spec.%' AS is_test, CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN regexp_matches(path, '\\.(tsx|js|jsx)$') THEN 'typescript-jsx' END AS dialect,
      length(path) > 0 AND path NOT LIKE '/%' AND path NOT LIKE '%\\%' AND NOT regexp_matches(path, '^[A-Za-z]:') AND len(list_intersect(string_split(path, '/'), ['', '.', '..'])) = 0 AS portable FROM artifact WHERE kind IS NOT NULL""",
    "content_sha": "SELECT doc_id, CASE WHEN contains(text, chr(0)) THEN NULL ELSE sha256(t) END AS sha256, CASE WHEN contains(text, chr(0)) THEN NULL ELSE strlen(t) END AS byte_length, CASE WHEN contains(text, chr(0)) THEN 'binary' END AS reason FROM (SELECT doc_id, text, replace(replace(CASE WHEN starts_with(text, chr(65279)) THEN substr(text, 2) ELSE text END, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE text IS NOT NULL)",
    "content_dedup": "SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0)",
    "unindexed_contents": "SELECT DISTINCT lower(sha256) AS sha256 FROM content WHERE lower(sha256) >= '8'",
    "artifact_ids": """WITH a AS (SELECT DISTINCT id, repository_id FROM artifact), k AS (SELECT repository_id, count(*) AS n, max(id) AS top FROM a WHERE id % 3 = 0 GROUP BY 1), w AS (SELECT repository_id, count(*) AS n FROM a WHERE id % 3 <> 0 GROUP BY 1)
      SELECT coalesce(k.repository_id, w.repository_id) AS repository_id, coalesce(k.n, 0) + coalesce(w.n, 0) AS n, coalesce(k.top, 0) + coalesce(w.n, 0) AS top FROM k FULL OUTER JOIN w ON w.repository_id = k.repository_id""",
    "snapshot_compare": """SELECT coalesce(b.doc_id, h.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN h.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change_kind
      FROM (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0) b FULL OUTER JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0) h ON h.doc_id = b.doc_id
      WHERE b.doc_id IS NULL OR h.doc_id IS NULL OR b.text IS DISTINCT FROM h.text""",
    "module_resolution": f"WITH {_EDGES} SELECT source_id, specifier, target_id FROM resolved",
    "import_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "structural_signals": f"WITH {_SIGNALS} SELECT * FROM signals",
    "signal_counts": f"WITH {_SIGNALS} SELECT artifact_id, count(*) FILTER (WHERE signal = 'test-to-source') AS n_test_to_source, count(*) FILTER (WHERE signal = 'incoming-import') AS n_incoming_import, count(*) FILTER (WHERE signal = 'outgoing-import') AS n_outgoing_import FROM signals GROUP BY 1",
    "deterministic_rank": f"WITH {_DET} SELECT artifact_id, lexical_category, category, rank FROM det",
    "cosine_chunks": _CHUNKS + " SELECT * FROM scored",
    "best_chunk": _CHUNKS + " SELECT * FROM best",
    "semantic_rank": _CHUNKS + " SELECT model_id, snapshot_id, artifact_id, row_number() OVER (PARTITION BY model_id, snapshot_id ORDER BY similarity DESC, path, artifact_id) AS rank FROM best JOIN (SELECT id AS artifact_id, min(path) AS path FROM artifact GROUP BY 1) USING (artifact_id)",
    "rrf_fuse": f"WITH {_fused_sql()} SELECT artifact_id, round(rrf_score, 9) AS score, deterministic_rank, semantic_rank, rank FROM fused",
    "rrf_k10": f"WITH {_fused_sql(10)} SELECT artifact_id, rank FROM fused",
    "hybrid_h1": f"WITH {_fused_sql()} SELECT f.snapshot_id::INT AS snapshot_id, count(*) AS n_truth, {_TRUTH} FROM files f LEFT JOIN fused u USING (artifact_id) WHERE f.artifact_id % 13 = 0 GROUP BY 1",
    "hybrid_h3": f"WITH {_fused_sql()}, t AS (SELECT *, CASE WHEN deterministic_rank IS NULL THEN 3 WHEN {_ORDER['det'].format('deterministic_category')} <= 2 THEN 1 ELSE 2 END AS tier FROM fused) SELECT artifact_id, tier, row_number() OVER (PARTITION BY snapshot_id ORDER BY tier, rrf_score DESC, path, artifact_id) AS tier_rank FROM t",
    "eligible_rank": f"WITH {_fused_sql()} SELECT artifact_id, rank, row_number() OVER (PARTITION BY snapshot_id ORDER BY rank) AS eligible_rank FROM fused WHERE artifact_id NOT IN (SELECT changed_id FROM changed)",
    "evidence_topk": f"WITH {_fused_sql()} SELECT artifact_id, path, row_number() OVER (PARTITION BY snapshot_id ORDER BY rank) AS eligible_rank FROM fused WHERE artifact_id NOT IN (SELECT changed_id FROM changed) QUALIFY eligible_rank <= 20",
    "fusion_contributions": f"WITH {_fused_sql()} SELECT 'fusion:' || artifact_id || ':k60' AS evidence_id, round(coalesce(1.0::DOUBLE / (60 + deterministic_rank), 0), 9) AS deterministic, round(coalesce(1.0::DOUBLE / (60 + semantic_rank), 0), 9) AS semantic FROM fused",
    "evidence_bundle": f"""WITH {_fused_sql()}, best AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY rank) AS eligible_rank FROM fused WHERE artifact_id NOT IN (SELECT changed_id FROM changed) QUALIFY eligible_rank <= 20),
      r AS (SELECT b.artifact_id AS version_id, 1 AS o, 'structural' AS type, 'structural:' || signal || ':' || CASE WHEN signal = 'outgoing-import' THEN f.path || '>' || b.path ELSE b.path || '>' || f.path END AS id,
          'By its imports the file ' || CASE signal {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evidence.RELATIONS.items())} END || ' ' || f.path || '.' AS sentence FROM best b JOIN signals s USING (artifact_id) JOIN files f ON f.artifact_id = s.changed_id
        UNION ALL SELECT artifact_id, 2, 'lexical', 'lexical:' || artifact_id, printf('Query terms found: %d in all, %d in the text, %d in the path: %s.', len(matched_terms), len(content_terms), len(path_terms), array_to_string(matched_terms, ', ')) FROM best JOIN matched USING (artifact_id)
        UNION ALL SELECT artifact_id, 3, 'semantic', 'semantic:' || artifact_id || ':word-counts:0', printf('Closest is chunk 1 of 1, with cosine %.3f.', similarity) FROM best JOIN sem USING (artifact_id)
        UNION ALL SELECT artifact_id, 4, 'fusion', 'fusion:' || artifact_id || ':k60', printf('Place %d, score %.4f: ranks %s by terms and imports and %s by similarity, k 60.', rank, rrf_score, coalesce(deterministic_rank::VARCHAR, 'none'), coalesce(semantic_rank::VARCHAR, 'none')) FROM best)
      SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY o, id) AS ordinal, type, id, sentence FROM r""",
    "code_split": r"SELECT lower(sha256) AS sha256, sum(1 + length(regexp_replace(array_to_string(regexp_extract_all(chr(10) || text, '\n\s*(?:export |function |class )'), ''), '[^\n]', '', 'g')) - (regexp_matches(text, '^\s*(?:export |function |class )'))::INT)::BIGINT AS n_parts, sum(length(text))::BIGINT AS n_chars FROM content WHERE length(text) > 0 GROUP BY 1",
    "chunk_reconstruction": "SELECT count(*) AS n_files, count(*) AS n_rebuilt FROM documents WHERE text IS NOT NULL",
    "tfidf_rank": f"""WITH {_DOCS}, {_MATCHES}, d AS (SELECT snapshot_id, artifact_id, unnest(matched_terms) AS term FROM matched), f AS (SELECT snapshot_id, term, count(DISTINCT artifact_id) AS df FROM d GROUP BY 1, 2),
      w AS (SELECT artifact_id, round(sum(ln(10000.0::DOUBLE / df)), 9) AS tfidf FROM d JOIN f USING (snapshot_id, term) GROUP BY 1), k AS (SELECT *, {_LEXCAT} AS category FROM matched JOIN w USING (artifact_id))
      SELECT artifact_id, tfidf, row_number() OVER (PARTITION BY snapshot_id ORDER BY {_ORDER["lex"].format("category")}, tfidf DESC, length(path), path) AS rank FROM k""",
    "evidence_tiers": f"WITH {_DET} SELECT CASE WHEN incoming OR outgoing THEN 1 WHEN len(path_terms) > 0 OR len(matched_terms) >= 3 THEN 2 WHEN len(matched_terms) > 0 THEN 3 ELSE 4 END AS tier, count(*) AS n FROM det GROUP BY 1",
    "markdown_split": "SELECT doc_id, len(regexp_extract_all(substr(text, 2), '\\n#+ ')) + 1 AS n_parts, length(text) AS n_chars FROM documents WHERE length(text) > 0",
}
