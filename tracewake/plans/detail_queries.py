"""Queries on single operators: query texts, excerpts, legacy matching, trees and histories, result checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewake.functions import dates, paths, text
from tracewake.operators import catalog, evaluate, evidence, fusion, graph, history, lexical, validate
from tracewake.plans import change_queries as ch
from tracewake.plans import evaluation_queries as ev
from tracewake.plans import retrieval_queries as rt
from tracewake.session import table

_WORDS = ["snapshot", "pipe", "Receipt"]


def hybrid_h2(spark, root):
    return fusion.score_then_level(rt._fused(spark, root)[3], ["snapshot_id"]).select("artifact_id", "level", "h2_rank")


def provenance_counts(spark, root):
    _, changed, _, det = rt._deterministic(spark, root)
    told = det.join(changed.select("snapshot_id", "artifact_id", F.lit(True).alias("changed")), ["snapshot_id", "artifact_id"], "left")
    structural = (F.col("n_test_to_source") + F.col("n_incoming_import") + F.col("n_outgoing_import")) > 0
    return history.provenance(told.select(structural.alias("structural"), (F.size("matched_terms") > 0).alias("lexical"), F.coalesce("changed", F.lit(False)).alias("changed")))


def open_questions(spark, root):
    """Limitations and open questions of every fused candidate, counted."""
    files, _, signals, fused = rt._fused(spark, root)
    by = ["snapshot_id"]
    none = F.array().cast("array<string>")
    rows = fused.join(graph.signal_counts(signals, by).select(*by, "artifact_id", "signals"), [*by, "artifact_id"], "left").join(rt._matches(files).select(*by, "artifact_id", "content_terms", "matched_terms"), [*by, "artifact_id"], "left")
    for c in ("content_terms", "matched_terms"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    return evidence.limitations(rows).groupBy("open_question").agg(F.count("*").alias("n"), F.sum(F.size("limitations")).alias("n_limitations"))


def excerpts(spark, root):
    return table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", text.excerpt(F.col("text"), 100).alias("e")).select("doc_id", "e.text", "e.truncated", "e.total_chars")


def query_texts(spark, root):
    """The two query texts for all paths of each ready snapshot."""
    rows = rt._ready_files(spark, root).filter("path IS NOT NULL").groupBy("snapshot_id").agg(F.sort_array(F.collect_set("path")).alias("changed"))
    what = F.concat(F.lit("Snapshot "), F.col("snapshot_id").cast("string"))
    return rows.select("snapshot_id", text.lexical_query_text(what, F.col("changed")).alias("lexical"), text.semantic_query_text(what, F.col("changed")).alias("semantic"))


def change_query_texts(spark, root):
    """The two query texts for all paths that changed between consecutive snapshots."""
    rows = ch.p1_found(spark, root).groupBy("base_snapshot_id", "target_snapshot_id").agg(F.sort_array(F.collect_set("path")).alias("changed"))
    what = F.concat(F.lit("Change "), F.col("target_snapshot_id").cast("string"))
    return rows.select("base_snapshot_id", "target_snapshot_id", text.lexical_query_text(what, F.col("changed")).alias("lexical"), text.semantic_query_text(what, F.col("changed")).alias("semantic"))


def normalised_times(spark, root):
    """Times written with one of three offsets, as UTC with milliseconds."""
    n = (F.col("doc_id") % 3).cast("int")
    written = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.array(F.lit("Z"), F.lit(".250+02:00"), F.lit("-05:30"))[n])
    return table(spark, root, "documents").filter("created_at IS NOT NULL").select("doc_id", dates.normalise_timestamp(written).alias("utc"))


def excluded_listing(spark, root):
    return table(spark, root, "excluded_entry").select("snapshot_id", "path", "reason").distinct()


def content_lookup(spark, root):
    """Lengths of the contents of each file's newest version."""
    newest = table(spark, root, "artifact_version").groupBy("artifact_id").agg(F.max_by("content_sha256", "id").alias("sha256"))
    return catalog.content_of(table(spark, root, "content"), newest).select("sha256", F.length("text").alias("n_chars"))


def legacy_terms(spark, root):
    return table(spark, root, "documents").select("doc_id", F.explode(text.legacy_terms(F.coalesce("text", F.lit("")))).alias("term"))


def legacy_substrings(spark, root):
    return lexical.substring_matches(table(spark, root, "documents"), _WORDS).select("doc_id", F.size("terms").alias("n_terms"))


def change_descriptions(spark, root):
    n = F.col("doc_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("added", "deleted", "modified", "renamed", "type_changed")]), (n % 5 + 1).cast("int"))
    previous = F.when(n % 5 == 3, F.concat(F.lit("old/"), n.cast("string")))
    rows = table(spark, root, "documents").select("doc_id", status.alias("status"), previous.alias("previous_path"), (n % 51 + 50).alias("similarity"), F.concat(F.lit("new/"), n.cast("string")).alias("path"))
    return rows.select("doc_id", paths.describe_change(F.col("status"), F.col("previous_path"), F.col("similarity")).alias("description"), F.size(paths.change_paths(F.array(F.struct("path", "previous_path")))).alias("n_paths"))


def tree_diff(spark, root):
    n = F.col("doc_id")
    rows = table(spark, root, "documents").filter("text IS NOT NULL")
    base = rows.filter(n % 7 != 0).select(F.concat(F.lit("p"), n.cast("string")).alias("path"), F.sha2("text", 256).alias("object_sha"), F.lit("100644").alias("mode"))
    moved = F.when(n % 13 == 0, F.concat(F.lit("moved/p"), n.cast("string"))).otherwise(F.concat(F.lit("p"), n.cast("string")))
    target = rows.filter(n % 11 != 0).select(moved.alias("path"), F.sha2(F.when(n % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("object_sha"), F.when(n % 29 == 0, "120000").otherwise("100644").alias("mode"))
    return history.diff_trees(base, target)


_TREES = """b AS (SELECT 'p' || doc_id AS path, sha256(text) AS sha, '100' AS mode FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0),
t AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'moved/p' ELSE 'p' END || doc_id AS path, sha256(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS sha, CASE WHEN doc_id % 29 = 0 THEN '120' ELSE '100' END AS mode FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0),
d AS (SELECT coalesce(b.path, t.path) AS path, coalesce(b.sha, t.sha) AS sha, CASE WHEN b.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'deleted' WHEN b.mode <> t.mode THEN 'type_changed' WHEN b.sha <> t.sha THEN 'modified' END AS status FROM b FULL OUTER JOIN t ON t.path = b.path),
n AS (SELECT *, row_number() OVER (PARTITION BY status, sha ORDER BY path) AS n FROM d WHERE status IS NOT NULL),
r AS (SELECT a.path, x.path AS previous_path, a.sha, a.n FROM n a JOIN n x ON x.sha = a.sha AND x.n = a.n AND x.status = 'deleted' WHERE a.status = 'added')"""


def _tree_commits(spark, root):
    k = F.col("o_orderkey")
    text_of = lambda c: c.cast("string")
    parents = F.when(k == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.array(text_of(F.floor(k / 2)), text_of(F.floor(k / 3)))).otherwise(F.array(text_of(F.floor(k / 2))))
    return table(spark, root, "orders").select(text_of(k).alias("sha"), parents.alias("parents"))


def history_reachable(spark, root):
    commits = _tree_commits(spark, root)
    return history.reachable(commits, commits.filter("CAST(sha AS BIGINT) % 1000 = 999").select("sha"))


def _results(spark, root):
    """A method and a status for every eligible commit."""
    rows = ev._judged(spark, root).filter("reason IS NULL")
    return rows.select(
        "commit", F.element_at(F.array(F.lit("hybrid"), F.lit("semantic")), (F.col("commit") % 2 + 1).cast("int")).alias("method"), F.element_at(F.array(F.lit("succeeded"), F.lit("failed"), F.lit("not_run")), (F.col("commit") % 3 + 1).cast("int")).alias("status")
    )


def method_status(spark, root):
    """Counts by status of every method, over all eligible commits."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n_commits"))), F.lit(0)).alias(f"n_{s}")
    return evaluate.method_status(_results(spark, root)).groupBy("method").agg(n("succeeded"), n("failed"), n("not_run"))


def method_status_counts(spark, root):
    return evaluate.method_status(_results(spark, root))


def method_status_commits(spark, root):
    """Every eligible commit that failed or did not run."""
    return evaluate.unfinished(_results(spark, root))


def record_checks(spark, root):
    """Results that have both a ranking and a failure or neither, and rankings that hold an input."""
    changes = ev._changes(spark, root)
    results = ev._commits(spark, root).select("commit", F.lit("hybrid").alias("method"), F.when(F.col("commit") % 10 == 0, "timeout").alias("failure"))
    ranking = changes.filter("class <> 'source' OR part % 401 = 3").select("commit", F.lit("hybrid").alias("method"), "path")
    return validate.record_violations(results, ranking, changes.filter("class = 'source'")).groupBy("problem").agg(F.count("*").alias("n"))


def manifest_checks(spark, root):
    """Selected commits whose inputs and targets break a rule of the selection."""
    e = ev.commit_selection(spark, root)
    sides = ev._changes(spark, root).groupBy("commit").agg(F.sort_array(F.collect_set(F.when(F.col("class") == "source", F.col("path")))).alias("inputs"), F.sort_array(F.collect_set(F.when((F.col("class") != "source") & (F.col("part") % 8 != 0), F.col("path")))).alias("targets"))
    rows = e.join(sides, "commit").withColumn("eligible_index", F.when(F.col("commit") % 500 == 1, -1).otherwise(F.col("eligible_index")))
    return validate.manifest_violations(rows).groupBy("problem").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (hybrid_h2, provenance_counts, open_questions, excerpts, query_texts, change_query_texts, normalised_times, excluded_listing, content_lookup, legacy_terms, legacy_substrings, change_descriptions, tree_diff, history_reachable, method_status, method_status_counts, method_status_commits, record_checks, manifest_checks)
}
_METHODS = "SELECT commit, CASE commit % 2 WHEN 0 THEN 'hybrid' ELSE 'semantic' END AS method, CASE commit % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'not_run' END AS status FROM judged WHERE reason IS NULL"
SQL = {
    "hybrid_h2": f"WITH {rt._fused_sql()}, l AS (SELECT *, CASE WHEN deterministic_category IS NOT NULL THEN {rt._ORDER['det'].format('deterministic_category')} END AS level FROM fused) SELECT artifact_id, level, row_number() OVER (PARTITION BY snapshot_id ORDER BY rrf_score DESC, coalesce(level, 99), path, artifact_id) AS h2_rank FROM l",
    "provenance_counts": f"WITH {rt._DET} SELECT count(*) FILTER (WHERE (incoming OR outgoing) AND len(matched_terms) = 0) AS only_structural, count(*) FILTER (WHERE NOT (incoming OR outgoing) AND len(matched_terms) > 0) AS only_lexical, count(*) FILTER (WHERE (incoming OR outgoing) AND len(matched_terms) > 0) AS both, count(*) FILTER (WHERE artifact_id IN (SELECT changed_id FROM changed)) AS changed, count(*) FILTER (WHERE artifact_id NOT IN (SELECT changed_id FROM changed)) AS unchanged FROM det",
    "open_questions": f"""WITH {rt._fused_sql()}, x AS (SELECT u.*, coalesce(c.incoming, false) AS i, coalesce(c.outgoing, false) AS o, coalesce(len(m.matched_terms), 0) AS mt, coalesce(len(m.content_terms), 0) AS ct FROM fused u LEFT JOIN counts c USING (artifact_id) LEFT JOIN matched m USING (artifact_id))
      SELECT CASE WHEN i THEN 'source' WHEN o THEN 'target' ELSE 'none' END AS open_question, count(*) AS n, sum((NOT i AND NOT o)::INT + (o AND NOT i)::INT + (i OR o)::INT + (mt > 0 AND ct = 0)::INT + (deterministic_rank IS NULL)::INT + (semantic_rank IS NULL)::INT)::BIGINT AS n_limitations FROM x GROUP BY 1""",
    "excerpts": """WITH w AS (SELECT doc_id, text, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units,
        list_max([k for k in range(0, 101) if k + length(regexp_replace(substr(text, 1, k), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) <= 100]) AS k FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, substr(text, 1, k) AS text, units > 100 AS truncated, units AS total_chars FROM w""",
    "query_texts": f"""WITH c AS (SELECT snapshot_id, list_sort(list(DISTINCT path)) AS changed FROM {rt._READY} WHERE path IS NOT NULL GROUP BY 1)
      SELECT snapshot_id, 'Snapshot ' || snapshot_id || ' ' || array_to_string([regexp_extract(p, '[^/]*$') for p in changed], ' ') AS lexical, 'search_query: Change Description: Snapshot ' || snapshot_id || chr(10) || 'Files Modified:' || chr(10) || array_to_string(['- ' || p for p in changed], chr(10)) AS semantic FROM c""",
    "change_query_texts": ch._SQL + """, c AS (SELECT base_snapshot_id, target_snapshot_id, list_sort(list(DISTINCT path)) AS changed FROM found GROUP BY 1, 2)
      SELECT base_snapshot_id, target_snapshot_id, 'Change ' || target_snapshot_id || ' ' || array_to_string([regexp_extract(p, '[^/]*$') for p in changed], ' ') AS lexical, 'search_query: Change Description: Change ' || target_snapshot_id || chr(10) || 'Files Modified:' || chr(10) || array_to_string(['- ' || p for p in changed], chr(10)) AS semantic FROM c""",
    "normalised_times": "SELECT doc_id, strftime(date_trunc('second', created_at) - CASE doc_id % 3 WHEN 1 THEN INTERVAL 2 HOUR WHEN 2 THEN -INTERVAL 330 MINUTE ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S') || CASE doc_id % 3 WHEN 1 THEN '.250Z' ELSE '.000Z' END AS utc FROM documents WHERE created_at IS NOT NULL",
    "excluded_listing": "SELECT DISTINCT snapshot_id, path, reason FROM excluded_entry",
    "content_lookup": "SELECT DISTINCT lower(sha256) AS sha256, length(text) AS n_chars FROM content WHERE lower(sha256) IN (SELECT arg_max(lower(content_sha256), id) FROM artifact_version GROUP BY artifact_id)",
    "legacy_terms": f"SELECT doc_id, unnest(list_distinct([t for t in regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+') if length(t) >= 3 AND NOT list_contains({rt.STOP}, t)])) AS term FROM documents",
    "legacy_substrings": "SELECT doc_id, n_terms FROM (SELECT doc_id, contains(lower(text), 'snapshot')::INT + contains(lower(text), 'pipe')::INT + contains(lower(text), 'receipt')::INT AS n_terms FROM documents WHERE text IS NOT NULL) WHERE n_terms > 0",
    "change_descriptions": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'modified' WHEN 3 THEN 'renamed from old/' || doc_id || ' (' || (doc_id % 51 + 50) || '% similar)' ELSE 'type changed' END AS description, CASE WHEN doc_id % 5 = 3 THEN 2 ELSE 1 END AS n_paths FROM documents",
    "tree_diff": f"WITH {_TREES} SELECT 'renamed' AS status, path, previous_path FROM r UNION ALL SELECT status, path, NULL FROM n WHERE status IN ('modified', 'type_changed') UNION ALL SELECT status, path, NULL FROM n WHERE status IN ('added', 'deleted') AND (sha, n.n) NOT IN (SELECT (sha, r.n) FROM r)",
    "history_reachable": "WITH RECURSIVE p AS (SELECT o_orderkey AS k, o_orderkey // 2 AS q FROM orders WHERE o_orderkey > 0 UNION SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey > 0 AND o_orderkey % 5 = 0), r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 1000 = 999 UNION SELECT p.q FROM r JOIN p ON p.k = r.k) SELECT k::VARCHAR AS sha FROM r",
    "method_status": f"WITH {ev._JUDGED}, m AS (SELECT CASE commit % 2 WHEN 0 THEN 'hybrid' ELSE 'semantic' END AS method, commit % 3 AS s FROM judged WHERE reason IS NULL) SELECT method, count(*) FILTER (WHERE s = 0) AS n_succeeded, count(*) FILTER (WHERE s = 1) AS n_failed, count(*) FILTER (WHERE s = 2) AS n_not_run FROM m GROUP BY 1",
    "method_status_counts": f"WITH {ev._JUDGED}, m AS ({_METHODS}) SELECT method, status, count(*) AS n_commits FROM m GROUP BY 1, 2",
    "method_status_commits": f"WITH {ev._JUDGED}, m AS ({_METHODS}) SELECT method, status, commit FROM m WHERE status <> 'succeeded'",
    "record_checks": f"""WITH {ev._HISTORY}, k AS (SELECT * FROM f WHERE class <> 'source' OR part % 401 = 3), x AS (SELECT c.commit, c.commit % 10 = 0 AS failed, c.commit IN (SELECT commit FROM k) AS ranked FROM c)
      SELECT 'a ranking or a failure, not both or neither' AS problem, count(*) AS n FROM x WHERE failed = ranked GROUP BY 1 HAVING count(*) > 0 UNION ALL SELECT 'the ranking holds an input', count(DISTINCT commit) FROM k WHERE class = 'source' HAVING count(*) > 0""",
    "manifest_checks": f"""WITH {ev._JUDGED}, s AS (SELECT e.commit, count(*) FILTER (WHERE class <> 'source' AND part % 8 <> 0) AS t FROM eligible e JOIN f USING (commit) GROUP BY 1)
      SELECT CASE WHEN t = 0 THEN 'no target' ELSE 'a negative index' END AS problem, count(*) AS n FROM s WHERE t = 0 OR commit % 500 = 1 GROUP BY 1""",
}
