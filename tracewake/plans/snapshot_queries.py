"""Queries on real snapshots: every change between consecutive snapshots is searched for in its target, whose chunks are embedded, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracewake.functions import paths, text, vectors
from tracewake.operators import assemble, fusion, graph, lexical, search
from tracewake.plans import change_queries as ch
from tracewake.plans import evaluation_queries as ev
from tracewake.plans import retrieval_queries as rt
from tracewake.session import cut_lineage, table

BY = ["snapshot_id"]
MODEL = "least"


def _key(sha256):
    return text.digest_key(F.lower(sha256))


def _files(spark, root):
    """Files of the ready snapshots, each with the path and kind of its artifact."""
    ready = table(spark, root, "repository_snapshot").filter("status = 'ready'").select(F.col("id").alias("snapshot_id")).distinct()
    named = table(spark, root, "artifact").groupBy(F.col("id").alias("artifact_id")).agg(F.min("path").alias("path"), F.min("kind").alias("kind"))
    versions = table(spark, root, "artifact_version").select("snapshot_id", "artifact_id", F.col("id").alias("version_id"), _key("content_sha256").alias("sha256"))
    return versions.join(ready, "snapshot_id", "left_semi").dropDuplicates(["version_id"]).join(named, "artifact_id").select(*BY, "artifact_id", "version_id", "path", "kind", "sha256")


def _imports(spark, root, files, by, key=F.lower):
    found = graph.content_imports(table(spark, root, "content").filter(F.contains("text", F.lit("import")))).filter("specifier IS NOT NULL").select(key("sha256").alias("sha256"), "specifier").distinct()
    return files.join(found, "sha256").select(*by, F.col("artifact_id").alias("source_id"), F.col("path").alias("source_path"), "specifier")


def _model(spark, root):
    """The embeddings of one model, the first by name."""
    e = table(spark, root, "semantic_embedding").filter(vectors.is_valid(F.col("vector"), F.col("dimensions")))
    first = e.agg(F.min("model_id").alias("model_id"))
    return e.join(F.broadcast(first), "model_id")


def _search(spark, root):
    """Changes are the change sets that led to a snapshot; the query vector of each is that of the first chunk, by hash, of the files that changed."""
    found = ch.p1_found(spark, root).groupBy(F.col("target_snapshot_id").alias("snapshot_id")).agg(F.sort_array(F.collect_set("path")).alias("changed"))
    changes = cut_lineage(found).withColumn("description", F.lit("Fix receipt and voucher session"))
    files = cut_lineage(_files(spark, root).join(changes, BY, "left_semi"))
    edges = graph.edges(graph.resolve_imports(_imports(spark, root, files, BY, _key), files, BY), files, BY)
    embeddings = _model(spark, root)
    chunks = table(spark, root, "semantic_chunk")
    seeds = files.join(changes.select(*BY, F.explode("changed").alias("path")), [*BY, "path"], "left_semi").select(*BY, "artifact_id")
    queries = chunks.join(seeds, [*BY, "artifact_id"], "left_semi").join(embeddings, ["model_id", "input_hash"]).groupBy(*BY, "model_id").agg(F.min_by("vector", "input_hash").alias("vector"))
    contents = lexical.content_token_lists(table(spark, root, "content")).withColumn("sha256", _key("sha256"))
    corpus = search.Corpus(files, contents, lexical.path_tokens(table(spark, root, "artifact")), edges, chunks, embeddings, BY)
    return corpus, changes, queries


def _settled(spark, root):
    """The search with its edges written down, of which the search and the checks of what it found are made."""
    corpus, changes, queries = _search(spark, root)
    return replace(corpus, edges=cut_lineage(corpus.edges)), changes, queries


def _run(spark, root):
    return search.search_hybrid(*_search(spark, root))


def change_lexical_matches(spark, root):
    """Files of each snapshot that hold terms of its change, by the stored index."""
    m = _run(spark, root).matches
    return m.select("snapshot_id", "artifact_id", F.size("content_terms").alias("n_content"), F.size("path_terms").alias("n_path"), F.array_join("matched_terms", " ").alias("terms"))


def change_deterministic_rank(spark, root):
    return _run(spark, root).deterministic.select("snapshot_id", "artifact_id", "category", "rank")


def change_semantic_rank(spark, root):
    return _run(spark, root).semantic.select("snapshot_id", "artifact_id", F.round("similarity", 6).alias("similarity"), "rank")


def search_hybrid(spark, root):
    """The fused ranking of every change between consecutive snapshots."""
    return _run(spark, root).fused.select("snapshot_id", "artifact_id", F.round("rrf_score", 9).alias("score"), "deterministic_rank", "semantic_rank", "rank")


def construct_evidence(spark, root):
    """The twenty best candidates of every change that did not change, each checked against its snapshot, and their evidence by type."""
    corpus, changes, queries = _settled(spark, root)
    run = search.search_hybrid(corpus, changes, queries, keep=cut_lineage)
    best, rows = search.construct_evidence(run, corpus, changes, MODEL)
    counted = rows.groupBy("snapshot_id", "version_id").agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("structural", "lexical", "semantic", "fusion")])
    return best.join(counted, ["snapshot_id", "version_id"]).select("snapshot_id", "artifact_id", "eligible_rank", "n_structural", "n_lexical", "n_semantic", "n_fusion")


def inconsistent_candidates(spark, root):
    """Candidates some of which were altered after the search: the checks name each."""
    corpus, changes, queries = _search(spark, root)
    run = search.search_hybrid(corpus, changes, queries)
    n = F.col("artifact_id") % 7
    altered = run.fused.withColumn("version_id", F.when(n == 1, F.col("version_id") + 1).otherwise(F.col("version_id"))).withColumn("path", F.when(n == 2, F.concat("path", F.lit("x"))).otherwise(F.col("path"))).withColumn("semantic_rank", F.when(n == 3, F.coalesce("semantic_rank", F.lit(0)) + 1).otherwise(F.col("semantic_rank"))).withColumn("deterministic_rank", F.when(n == 4, F.coalesce("deterministic_rank", F.lit(0)) + 1).otherwise(F.col("deterministic_rank")))
    return search.inconsistent_candidates(altered, run, corpus)


def investigate_changes(spark, root):
    """What a reader gets for every change: files in order, with what their evidence cannot show."""
    corpus, changes, queries = _settled(spark, root)
    found = search.investigate_changes(corpus, changes, queries, MODEL)
    return found.select("snapshot_id", "artifact_id", "eligible_rank", "n_evidence", F.array_join("limitations", " ").alias("limitations"), "open_question")


def _workspace(spark, root):
    """The files of all repositories as one tree: of every path the newest version of its least artifact."""
    v = table(spark, root, "artifact_version").groupBy("artifact_id").agg(F.max_by(F.lower("content_sha256"), "id").alias("sha256"), F.max("id").alias("version_id"))
    a = table(spark, root, "artifact").filter("path IS NOT NULL").groupBy("path").agg(F.min(F.struct("id", "kind")).alias("a"))
    return a.select("path", F.col("a.id").alias("artifact_id"), F.col("a.kind").alias("kind")).join(v, "artifact_id")


def workspace_edges(spark, root):
    """Import edges that the files' own text declares, over the files of all repositories as one tree."""
    files = _workspace(spark, root)
    return graph.edges(graph.resolve_imports(_imports(spark, root, files, []), files, []), files, []).select("source_id", "target_id", "kind")


def _related(spark, root, direction):
    files = _workspace(spark, root)
    edges = graph.edges(graph.resolve_imports(_imports(spark, root, files, []), files, []), files, [])
    return graph.relationships(edges, files, files.filter("artifact_id % 2 = 0"), [], direction).select("relationship", "source_path", "target_path", "source_version_id", "target_version_id")


def incoming_relationships(spark, root):
    return _related(spark, root, "incoming")


def outgoing_relationships(spark, root):
    return _related(spark, root, "outgoing")


def edge_declarations(spark, root):
    """The import declarations behind every edge of the tree of all repositories."""
    files = _workspace(spark, root)
    found = graph.edge_declarations(graph.resolve_imports(_imports(spark, root, files, []), files, []), files, table(spark, root, "content"), [])
    return found.select("source_id", "target_id", F.inline("declarations")).select("source_id", "target_id", "specifier", "start_line", "end_line", F.col("excerpt.text").alias("shown"))


def index_counters(spark, root):
    rows = table(spark, root, "content").select(F.lower("sha256").alias("sha256"))
    return lexical.index_counts(rows, rows.filter("sha256 < '8'"))


def change_h2_rank(spark, root):
    """Each change's candidates by score, then level of the category."""
    return fusion.score_then_level(_run(spark, root).fused, BY).select("snapshot_id", "artifact_id", "level", "h2_rank")


def five_arms(spark, root):
    """The first twenty of each evaluation arm for every change, after its changed source files."""
    corpus, changes, queries = _search(spark, root)
    is_input = (paths.kind(F.col("path")) == "code") & ~paths.is_test(F.col("path"))
    inputs = changes.select(*BY, F.explode("changed").alias("path")).filter(is_input)
    tests = corpus.files.filter(paths.is_test(F.col("path"))).select(*BY, "path")
    return assemble.five_arms(corpus, changes, queries, queries, inputs, tests).select("snapshot_id", "method", "path", "position")


QUERIES = {
    f.__name__: f
    for f in (
        change_lexical_matches, change_deterministic_rank, change_semantic_rank, search_hybrid, construct_evidence, inconsistent_candidates, investigate_changes, workspace_edges, incoming_relationships, outgoing_relationships,
        edge_declarations, index_counters, change_h2_rank, five_arms,
    )
}

_TERMS = "[t for t in {0} if length(t) >= 3 AND NOT list_contains(" + rt.STOP + ", t)]"
#: Imports of the test data stand at the beginning of a line, one in a line.
_DECLARED = "regexp_extract_all(text, '(?m)^import (?:type )?[^''\"`;]*?(?:from )?[''\"]([^''\"\\n]+)[''\"]', 1)"


def _resolved(files: str, by: str) -> str:
    """CTEs that end in ``edges`` over relation ``files`` (with columns ``by``, if any)."""
    b, w, using = (f"{by}, ", f"w.{by}, ", f"AND f.{by} = w.{by}") if by else ("", "", "")
    return f"""declared AS (SELECT DISTINCT lower(sha256) AS sha256, unnest({_DECLARED}) AS specifier FROM content),
imports AS (SELECT DISTINCT {b}artifact_id AS source_id, path, specifier, string_split(path, '/')[:-2] AS folder, [x for x in string_split(specifier, '/') if x NOT IN ('.', '..')] AS rest, len([x for x in string_split(specifier, '/') if x = '..']) AS up FROM {files} JOIN declared USING (sha256) WHERE starts_with(specifier, '.')),
w AS (SELECT {b}source_id, path, specifier, array_to_string(folder[:len(folder) - up] || rest, '/') AS base FROM imports WHERE up <= len(folder)),
tried AS (SELECT {b}source_id, path, specifier, base, unnest([{", ".join(f"{{'s': base || '{x}', 'p': {i}}}" for i, x in enumerate(paths.SUFFIXES))}]
  || CASE WHEN base LIKE '%.js' THEN [{{'s': base[:-4] || '.ts', 'p': 10}}, {{'s': base[:-4] || '.tsx', 'p': 11}}] ELSE [] END) AS c FROM w),
hits AS (SELECT {b.replace(by, "w." + by) if by else ""}w.source_id, w.path, specifier, c.p AS p, f.artifact_id AS target_id FROM tried w JOIN {files} f ON f.path = c.s {using}),
resolved AS (SELECT {b}source_id, any_value(path) AS source_path, specifier, arg_min(target_id, p) AS target_id FROM hits GROUP BY {b}source_id, specifier),
pairs AS (SELECT DISTINCT {b}source_id, source_path, target_id FROM resolved WHERE source_id <> target_id),
edges AS (SELECT {b}source_id, target_id, 'imports' AS kind FROM pairs UNION ALL SELECT {b}source_id, target_id, 'test-to-source' FROM pairs WHERE source_path LIKE '%.test.%' OR source_path LIKE '%.spec.%')"""


_FILES = f"files AS (SELECT f.*, k.kind FROM {rt._READY} f JOIN (SELECT id, min(kind) AS kind FROM artifact GROUP BY 1) k ON k.id = f.artifact_id)"
_CHANGES = ch._SQL.replace("WITH chain", "chain", 1).strip() + """, changes AS (SELECT target_snapshot_id AS snapshot_id, list_sort(list(DISTINCT path)) AS changed FROM found GROUP BY 1),
seeds AS (SELECT f.snapshot_id, f.artifact_id FROM files f JOIN changes c ON c.snapshot_id = f.snapshot_id AND list_contains(c.changed, f.path))"""
_QUERY = "'Fix receipt and voucher session ' || array_to_string([regexp_extract(p, '[^/]*$') for p in changed], ' ')"
_MATCHED = f"""terms AS (SELECT snapshot_id, unnest({_TERMS.format(rt.tokens_sql("q"))}) AS token FROM (SELECT snapshot_id, {_QUERY} AS q FROM changes)),
ci AS (SELECT DISTINCT lower(sha256) AS sha256, unnest({rt.tokens_sql("text")}) AS token FROM content), pi AS (SELECT DISTINCT id AS artifact_id, unnest({rt.tokens_sql("path")}) AS token FROM artifact WHERE path IS NOT NULL),
wanted AS (SELECT DISTINCT token FROM terms),
hits1 AS (SELECT DISTINCT f.snapshot_id, f.artifact_id, token, true AS c FROM files f JOIN ci USING (sha256) WHERE token IN (SELECT token FROM wanted) UNION ALL SELECT DISTINCT f.snapshot_id, f.artifact_id, token, false FROM files f JOIN pi USING (artifact_id) WHERE token IN (SELECT token FROM wanted)),
matched AS (SELECT snapshot_id, artifact_id, coalesce(list_sort(list(DISTINCT token) FILTER (WHERE c)), []) AS content_terms, coalesce(list_sort(list(DISTINCT token) FILTER (WHERE NOT c)), []) AS path_terms, list_sort(list(DISTINCT token)) AS matched_terms FROM hits1 JOIN terms USING (snapshot_id, token) GROUP BY 1, 2)"""
_DET = f"""signals AS (SELECT e.snapshot_id, source_id AS artifact_id, CASE WHEN max(kind = 'test-to-source') THEN 'test-to-source' ELSE 'incoming-import' END AS signal, target_id AS changed_id FROM edges e JOIN seeds s ON s.snapshot_id = e.snapshot_id AND s.artifact_id = target_id GROUP BY 1, 2, 4
  UNION ALL SELECT DISTINCT e.snapshot_id, target_id, 'outgoing-import', source_id FROM edges e JOIN seeds s ON s.snapshot_id = e.snapshot_id AND s.artifact_id = source_id WHERE kind = 'imports'),
counts AS (SELECT snapshot_id, artifact_id, max(signal <> 'outgoing-import') AS incoming, max(signal = 'outgoing-import') AS outgoing, count(*) AS n FROM signals GROUP BY 1, 2),
det0 AS (SELECT f.snapshot_id, f.artifact_id, f.version_id, f.path, coalesce(m.content_terms, []) AS content_terms, coalesce(m.path_terms, []) AS path_terms, coalesce(m.matched_terms, []) AS matched_terms, coalesce(c.incoming, false) AS incoming, coalesce(c.outgoing, false) AS outgoing, coalesce(c.n, 0) AS n
  FROM files f LEFT JOIN matched m USING (snapshot_id, artifact_id) LEFT JOIN counts c USING (snapshot_id, artifact_id) WHERE f.snapshot_id IN (SELECT snapshot_id FROM changes) AND (m.artifact_id IS NOT NULL OR c.artifact_id IS NOT NULL)),
det1 AS (SELECT *, {rt._LEXCAT} AS lexical_category FROM det0),
det2 AS (SELECT *, CASE WHEN incoming THEN 'critical-structural' WHEN lexical_category IN ('path-and-multi-content', 'high-content-density') THEN lexical_category WHEN outgoing THEN 'weak-structural' ELSE lexical_category END AS category FROM det1),
det AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY {rt._ORDER["det"].format("category")}, {rt._STRENGTH}) AS rank FROM det2)"""
_SEM = """e AS (SELECT DISTINCT input_hash, [x::DOUBLE for x in vector] AS v FROM semantic_embedding WHERE vector IS NOT NULL AND len(vector) = dimensions AND len([x for x in vector if isnan(x)]) = 0 AND len([x for x in vector if x <> 0]) > 0
  AND model_id = (SELECT min(model_id) FROM semantic_embedding WHERE vector IS NOT NULL AND len(vector) = dimensions AND len([x for x in vector if isnan(x)]) = 0 AND len([x for x in vector if x <> 0]) > 0)),
k AS (SELECT DISTINCT snapshot_id, artifact_id, chunk_index, input_hash FROM semantic_chunk WHERE model_id = (SELECT min(model_id) FROM semantic_embedding WHERE vector IS NOT NULL AND len(vector) = dimensions AND len([x for x in vector if isnan(x)]) = 0 AND len([x for x in vector if x <> 0]) > 0)),
q AS (SELECT snapshot_id, arg_min(v, input_hash) AS q FROM k JOIN seeds USING (snapshot_id, artifact_id) JOIN e USING (input_hash) GROUP BY 1),
sims AS (SELECT snapshot_id, artifact_id, max(round(list_sum([v[i] * q[i] for i in range(1, len(v) + 1)]) / (sqrt(list_sum([x * x for x in v])) * sqrt(list_sum([x * x for x in q]))), 9)) AS similarity FROM k JOIN q USING (snapshot_id) JOIN e USING (input_hash) GROUP BY 1, 2),
sem AS (SELECT s.*, f.version_id, f.path, row_number() OVER (PARTITION BY snapshot_id ORDER BY similarity DESC, path, artifact_id) AS rank FROM sims s JOIN files f USING (snapshot_id, artifact_id))"""
_FUSED = f"""fused0 AS (SELECT coalesce(d.snapshot_id, s.snapshot_id) AS snapshot_id, coalesce(d.artifact_id, s.artifact_id) AS artifact_id, coalesce(d.version_id, s.version_id) AS version_id, coalesce(d.path, s.path) AS path, d.rank AS deterministic_rank, s.rank AS semantic_rank, d.category AS deterministic_category,
  coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS rrf_score FROM det d FULL OUTER JOIN sem s ON s.snapshot_id = d.snapshot_id AND s.artifact_id = d.artifact_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY rrf_score DESC, {rt._ORDER["det"].format("deterministic_category")}, path, artifact_id) AS rank FROM fused0),
best AS (SELECT u.*, row_number() OVER (PARTITION BY u.snapshot_id ORDER BY rank) AS eligible_rank FROM fused u WHERE (snapshot_id, artifact_id) NOT IN (SELECT (snapshot_id, artifact_id) FROM seeds) QUALIFY eligible_rank <= 20),
full_ AS (SELECT b.*, coalesce(d.incoming, false) AS i, coalesce(d.outgoing, false) AS o, coalesce(d.n, 0) AS n_structural, coalesce(len(d.matched_terms), 0) AS mt, coalesce(len(d.content_terms), 0) AS ct FROM best b LEFT JOIN det d USING (snapshot_id, artifact_id))"""
_ALL = f"WITH {_FILES}, {_CHANGES}, {_resolved('files', 'snapshot_id')}, {_MATCHED}, {_DET}, {_SEM}, {_FUSED}"
_TREE = f"""WITH newest AS (SELECT artifact_id, max(id) AS version_id, arg_max(lower(content_sha256), id) AS sha256 FROM artifact_version GROUP BY 1),
tree AS (SELECT path, min((id, kind))[1] AS artifact_id, min((id, kind))[2] AS kind FROM artifact WHERE path IS NOT NULL GROUP BY 1), files AS (SELECT * FROM tree JOIN newest USING (artifact_id)), {_resolved("files", "")}"""
_BOTH = "SELECT e.kind AS relationship, s.path AS source_path, t.path AS target_path, s.version_id AS source_version_id, t.version_id AS target_version_id FROM edges e JOIN files s ON s.artifact_id = e.source_id JOIN files t ON t.artifact_id = e.target_id"
_BARE = _ALL.replace("'Fix receipt and voucher session '", "''")
_INPUT = f"{rt._KIND} = 'code' AND path NOT LIKE '%.test.%' AND path NOT LIKE '%.spec.%'"
_ARM_INPUTS = f"SELECT snapshot_id, path FROM (WITH {_FILES}, {_CHANGES} SELECT snapshot_id, unnest(changed) AS path FROM changes) WHERE {_INPUT}"
_ARM_TESTS = f"SELECT DISTINCT f.snapshot_id, path FROM (WITH {_FILES} SELECT * FROM files) f WHERE path LIKE '%.test.%' OR path LIKE '%.spec.%'"
_SIBLINGS = (
    ev._SIBLING.replace("WITH a AS (SELECT DISTINCT repository_id AS r, path FROM artifact WHERE kind = 'code' AND path IS NOT NULL)", f"WITH a_in AS (SELECT DISTINCT snapshot_id AS r, path FROM ({_ARM_INPUTS})), a_t AS (SELECT snapshot_id AS r, path FROM ({_ARM_TESTS}))")
    .replace("FROM a WHERE path NOT LIKE '%.test.%' AND path NOT LIKE '%.spec.%'", "FROM a_in").replace("FROM a WHERE path LIKE '%.test.%' OR path LIKE '%.spec.%'", "FROM a_t").replace(" QUALIFY rank <= 20", "")
)
SQL = {
    # A query of the retrieval module over the same files, of those that some dialect of the scanner reads.
    "snapshot_import_edges": f"WITH {_FILES}, {_resolved('files', 'snapshot_id')} SELECT snapshot_id, source_id, target_id, kind FROM edges WHERE source_id IN (SELECT artifact_id FROM files WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx)$'))",
    "five_arms": f"""WITH lists AS (SELECT 'hybrid' AS method, * FROM ({_ALL} SELECT snapshot_id, path, rank FROM fused) UNION ALL SELECT 'deterministic', * FROM ({_ALL} SELECT snapshot_id, path, rank FROM det) UNION ALL SELECT 'semantic', * FROM ({_ALL} SELECT snapshot_id, path, rank FROM sem)
      UNION ALL SELECT 'no-description', * FROM ({_BARE} SELECT snapshot_id, path, rank FROM fused) UNION ALL SELECT 'sibling', repository_id, path, rank FROM ({_SIBLINGS})), inputs AS ({_ARM_INPUTS})
      SELECT snapshot_id, method, path, row_number() OVER (PARTITION BY snapshot_id, method ORDER BY rank) AS position FROM lists WHERE (snapshot_id, path) NOT IN (SELECT (snapshot_id, path) FROM inputs) QUALIFY position <= 20""",
    "change_lexical_matches": _ALL + " SELECT snapshot_id, artifact_id, len(content_terms) AS n_content, len(path_terms) AS n_path, array_to_string(matched_terms, ' ') AS terms FROM matched",
    "change_deterministic_rank": _ALL + " SELECT snapshot_id, artifact_id, category, rank FROM det",
    "change_semantic_rank": _ALL + " SELECT snapshot_id, artifact_id, round(similarity, 6) AS similarity, rank FROM sem",
    "search_hybrid": _ALL + " SELECT snapshot_id, artifact_id, round(rrf_score, 9) AS score, deterministic_rank, semantic_rank, rank FROM fused",
    "construct_evidence": _ALL + " SELECT snapshot_id, artifact_id, eligible_rank, n_structural, (mt > 0)::BIGINT AS n_lexical, (semantic_rank IS NOT NULL)::BIGINT AS n_semantic, 1::BIGINT AS n_fusion FROM full_",
    "inconsistent_candidates": _ALL + """ SELECT snapshot_id, artifact_id, CASE artifact_id % 7 WHEN 1 THEN 'not in the snapshot' WHEN 2 THEN 'not in the snapshot' WHEN 3 THEN 'not so in the semantic ranking' ELSE 'not so in the deterministic ranking' END AS problem FROM fused WHERE artifact_id % 7 BETWEEN 1 AND 4""",
    "investigate_changes": _ALL + """ SELECT snapshot_id, artifact_id, eligible_rank, n_structural + (mt > 0)::BIGINT + (semantic_rank IS NOT NULL)::BIGINT + 1 AS n_evidence,
      array_to_string([x for x in [CASE WHEN NOT i AND NOT o THEN 'no-tie' END, CASE WHEN o AND NOT i THEN 'dependency' END, CASE WHEN i OR o THEN 'coarse' END, CASE WHEN mt > 0 AND ct = 0 THEN 'path-terms' END, CASE WHEN deterministic_rank IS NULL THEN 'unranked' END, CASE WHEN semantic_rank IS NULL THEN 'dissimilar' END] if x IS NOT NULL], ' ') AS limitations,
      CASE WHEN i THEN 'source' WHEN o THEN 'target' ELSE 'none' END AS open_question FROM full_""",
    "workspace_edges": _TREE + " SELECT * FROM edges",
    "incoming_relationships": f"{_TREE} {_BOTH} WHERE e.target_id % 2 = 0",
    "outgoing_relationships": f"{_TREE} {_BOTH} WHERE e.source_id % 2 = 0",
    "index_counters": "SELECT count(*) FILTER (WHERE s >= '8') AS to_index, count(*) FILTER (WHERE s < '8') AS reused FROM (SELECT DISTINCT lower(sha256) AS s FROM content)",
    "change_h2_rank": _ALL + f", l AS (SELECT *, CASE WHEN deterministic_category IS NOT NULL THEN {rt._ORDER['det'].format('deterministic_category')} END AS level FROM fused) SELECT snapshot_id, artifact_id, level, row_number() OVER (PARTITION BY snapshot_id ORDER BY rrf_score DESC, coalesce(level, 99), path, artifact_id) AS h2_rank FROM l",
}
